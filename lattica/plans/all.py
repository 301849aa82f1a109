"""All queries of the engine's own operators, and what is left out."""

from __future__ import annotations

from lattica.plans import points, streams, tables, views  # noqa: F401  (registration)
from lattica.plans.registry import QUERIES, SQL  # noqa: F401

#: Operators of the inventory that are not offered, and why.
NOT_PORTED = {
    "SRC20": "probing HTTP servers for ranges is the file system client's task",
    "SRC34": "no JPEG 2000 decoder is available; such arrays are reported as unsupported",
    "SRC35": "Spark's tasks are the decoding pool",
    "SNK8": "no image encoders are available",
    "SNK12": "no image encoders are available",
    "MIN4": "belongs to image encoding",
    "MIN5": "belongs to image encoding",
    "CHK4": "belongs to image encoding",
    "GEO17": "rendering",
    "CLR18": "rendering on the GPU",
    "UDF2": "user interface",
    "MIN18": "rendering",
    "CHK6": "needs the network",
}

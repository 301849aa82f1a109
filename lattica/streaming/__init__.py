"""Progressive scans and request life cycles."""

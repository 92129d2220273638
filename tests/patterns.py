import re


def python_pattern(java: str) -> str:
    """A fixed pattern in the notation of Python's ``regex`` module."""
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m.group(1).zfill(4), java).replace("(?iu)", "(?i)")

"""Names on the driver."""

from __future__ import annotations

import re


def slug(name: str) -> str:
    lowered = "".join(c.lower() if c.isascii() else c for c in name)
    return re.sub("[^a-z0-9]+", "_", lowered).strip("_")

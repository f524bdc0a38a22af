"""Module size thresholds. Warn, block, critical."""

from __future__ import annotations

FILE_NLOC = (500, 900, 1800)
FUNCTION_NLOC = (80, 120, 200)
COMPLEXITY = (15, 25, 40)
FAN_OUT = (12, 18, 25)
EXPORTS = (15, 25, 40)
DUPLICATE_WINDOWS = (3, 12)
LONG_FUNCTIONS_SHOWN = 12

TITLES = {
    "scan-blocker": "Scanner could not fully parse file",
    "god-module": "File is acting like a god module",
    "oversized-file": "File is too large for a healthy unit of change",
    "hub-module": "Module fan-out is too wide",
    "export-surface-sprawl": "Public surface is too wide",
    "mixed-responsibility": "Module is mixing too many responsibilities",
    "duplication-cluster": "Repeated code blocks are accumulating in the same hotspot",
}

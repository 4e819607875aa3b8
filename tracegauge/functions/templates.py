"""The constraint templates as column expressions over pair statistics.

For a trace and activities x, y: cx, cy counts; fx, lx, fy, ly first and last positions (null if absent);
b adjacent (x, y); gx (gy) gaps between consecutive x (y) that contain a y (x); xb x before the last y; ya y
after the first x.  Two semantics exist and disagree on purpose: ``trace`` (satisfied, violated or vacuous)
and ``event`` (activations and fulfilled activations).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNARY = ("Init", "End")
#: Binary templates that candidate generation enumerates.
ENABLED = (
    "Response", "AlternateResponse", "ChainResponse", "NotResponse",
    "Succession", "AlternateSuccession", "ChainSuccession", "NotChainSuccession",
)
BINARY = (
    "RespondedExistence", "NotRespondedExistence", "Response", "AlternateResponse", "ChainResponse", "Precedence",
    "AlternatePrecedence", "ChainPrecedence", "NotResponse", "NotChainResponse", "NotPrecedence",
    "NotChainPrecedence", "Succession", "AlternateSuccession", "ChainSuccession", "NotSuccession",
    "NotChainSuccession",
)
#: Templates with trace semantics (the existence pair has event semantics only).
TRACE_BINARY = BINARY[2:]
NEGATIVE = ("NotResponse", "NotChainSuccession")

STATS = ("cx", "cy", "fx", "lx", "fy", "ly", "b", "gx", "gy", "xb", "ya")


#: A trace with x and no y, and one with y and no x: what the statistics are then.
X_ONLY = {"cy": "0", "fx": "0", "lx": "0", "fy": "null", "ly": "null", "b": "0", "gx": "0", "gy": "0", "xb": "0", "ya": "0"}
Y_ONLY = {"cx": "0", "fx": "null", "lx": "null", "fy": "0", "ly": "0", "b": "0", "gx": "0", "gy": "0", "xb": "0", "ya": "0"}

# (activations, fulfilled activations) ... expressions are SQL text: one parse builds each, where the column
# API would take a call for every operator
EVENT = {
    "RespondedExistence": ("{cx}", "if({cy} > 0, {cx}, 0)"),
    "NotRespondedExistence": ("{cx}", "if({cy} = 0, {cx}, 0)"),
    "Response": ("{cx}", "{xb}"),
    "AlternateResponse": ("greatest({cx} - 1, 0)", "{gx}"),
    "ChainResponse": ("{cx}", "{b}"),
    "Precedence": ("{cy}", "{ya}"),
    "AlternatePrecedence": ("greatest({cy} - 1, 0)", "{gy}"),
    "ChainPrecedence": ("{cy}", "{b}"),
    "NotResponse": ("if({cy} > 0, {cx}, 0)", "if({cy} > 0, {cx} - {xb}, 0)"),
    "NotChainResponse": ("{cx}", "{cx} - {b}"),
    "NotPrecedence": ("{cy}", "{cy} - {ya}"),
    "NotChainPrecedence": ("{cy}", "{cy} - {b}"),
    "Succession": ("{cx} + {cy}", "{xb} + {ya}"),
    "AlternateSuccession": ("greatest({cx} - 1, 0) + greatest({cy} - 1, 0)", "{gx} + {gy}"),
    "ChainSuccession": ("{cx} + {cy}", "2 * {b}"),
    "NotSuccession": ("{cx} + {cy}", "({cx} - {xb}) + ({cy} - {ya})"),
    "NotChainSuccession": ("if({cx} > 0 and {cy} > 0, {cx} + {cy}, 0)", "if({cx} > 0 and {cy} > 0, {cx} + {cy} - 2 * {b}, 0)"),
}
# (applicable, satisfied)
_BOTH, _EVERY_X, _EVERY_Y = "{cx} > 0 and {cy} > 0", "{gx} = greatest({cx} - 1, 0)", "{gy} = greatest({cy} - 1, 0)"
TRACE = {
    "Response": ("{cx} > 0", "{ly} > {lx}"),
    "AlternateResponse": ("{cx} > 0", _EVERY_X),
    "ChainResponse": ("{cx} > 0", "{b} = {cx}"),
    "Precedence": ("{cy} > 0", "{fx} < {fy}"),
    "AlternatePrecedence": ("{cy} > 0", _EVERY_Y),
    "ChainPrecedence": ("{cy} > 0", "{b} = {cy}"),
    "NotResponse": (_BOTH, "{ly} < {fx}"),
    "NotChainResponse": (_BOTH, "{b} = 0"),
    "NotPrecedence": ("{cy} > 0", "{cx} = 0 or {fx} > {ly}"),
    "NotChainPrecedence": (_BOTH, "{b} = 0"),
    "Succession": (_BOTH, "{ly} > {lx} and {fx} < {fy}"),
    "AlternateSuccession": (_BOTH, f"{_EVERY_X} and {_EVERY_Y}"),
    "ChainSuccession": (_BOTH, "{b} = {cx} and {b} = {cy}"),
    "NotSuccession": (_BOTH, "{ly} < {fx}"),
    "NotChainSuccession": (_BOTH, "{b} = 0"),
}


def event(name: str, missing: dict | None = None) -> tuple[str, str]:
    """(activations, fulfilled activations) as SQL; ``missing``: X_ONLY or Y_ONLY for such traces."""
    s = {k: k for k in STATS} | (missing or {})
    return tuple(x.format(**s) for x in EVENT[name])


def holds(name: str, missing: dict | None = None) -> tuple[str, str]:
    """(applicable, satisfied) as SQL; both are never null."""
    s = {k: k for k in STATS} | (missing or {})
    app, sat = (x.format(**s) for x in TRACE[name])
    return app, f"coalesce({sat}, false)"


def family(ctype: str = "ctype") -> Column:
    """Template family of a constraint."""
    c = F.col(ctype)
    return (
        F.when(c.startswith("Not"), "Negative").when(c.isin(*UNARY), "Unary").when(c.endswith("Succession"), "Succession")
        .when(c.endswith("Precedence"), "Precedence").otherwise("Response")
    )

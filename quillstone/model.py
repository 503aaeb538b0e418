"""Record schemas, closed sets and tunables of the knowledge log."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed sets of the log format, and the order of statuses in the merge lattice.
KINDS = ("fact", "decision", "rejected", "constraint", "question", "claim")
STATUS_RANK = {"proposed": 0, "active": 1, "superseded": 2, "rejected": 3, "archived": 4}
CONFIDENCES = ("high", "medium", "low")
CONFIDENCE_SHORT = {"med": "medium"}
RECORD_TAGS = ("claim", "status", "counter", "doc")
#: Branch of records that name none; it sees only itself.
DEFAULT_BRANCH = "default"
#: Reference that a merged copy carries to its original; bookkeeping that readers don't follow.
MERGE_PREFIX = "merged:"
#: Identifier prefix of status records that a supersession implies.
IMPLIED = "sup:"

_S, _L, _TS = T.StringType(), T.LongType(), T.TimestampType()
#: The union of all record types: one JSON object a line, told apart by ``rec``.
RECORD = T.StructType(
    [T.StructField(n, _S) for n in ("rec", "id", "cid", "kind", "branch", "text", "why")]
    + [T.StructField("refs", T.ArrayType(_S)), T.StructField("entities", T.ArrayType(_S))]
    + [T.StructField(n, _S) for n in ("supersedes", "status", "confidence", "src")]
    # inline counts of a claim are maps, those of a counter record numbers: kept as JSON text
    + [T.StructField("helpful", _S), T.StructField("harmful", _S)]
    + [T.StructField(n, _TS) for n in ("last_used", "t_valid", "t_tx")]
    + [T.StructField("tokens", _L)]
    + [T.StructField(n, _S) for n in ("claim", "to", "reason", "machine", "name", "title", "body", "_corrupt_record")]
)
CLAIM_COLUMNS = ("id", "cid", "kind", "branch", "text", "why", "refs", "entities", "supersedes", "status", "confidence", "src", "last_used", "t_valid", "t_tx", "tokens")


def lookup(table: dict, key: Column | str, default=None) -> Column:
    """The value of ``key`` in a small constant table."""
    key = F.col(key) if isinstance(key, str) else key
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def rank(status: Column | str) -> Column:
    return lookup(STATUS_RANK, status)


def status_of(rank_column: Column | str) -> Column:
    return lookup({v: k for k, v in STATUS_RANK.items()}, rank_column)


def kind_of(text: Column | str) -> Column:
    """A kind in any case; null for anything else."""
    lower = F.lower(text)
    return F.when(lower.isin(*KINDS), lower)


def confidence_of(text: Column | str) -> Column:
    lower = F.lower(text)
    return F.when(lower.isin(*CONFIDENCES), lower).when(lower == "med", "medium")


@dataclass(frozen=True)
class Weights:
    """What the selection multiplies and adds; any of them can be overridden."""

    # The defaults that packs are compared under.
    alpha: float = 1.0
    beta: float = 0.6
    gamma: float = 0.4
    half_life_days: float = 180.0
    why_pass_threshold: float = 0.15
    kind: dict = field(default_factory=lambda: {"constraint": 1.0, "decision": 1.0, "rejected": 0.9, "fact": 0.8, "question": 0.7, "claim": 0.6})
    confidence: dict = field(default_factory=lambda: {"high": 1.0, "medium": 0.8, "low": 0.5})
    status: dict = field(default_factory=lambda: {"active": 1.0, "superseded": 0.15, "archived": 0.0})

    @classmethod
    def of(cls, values: dict | None) -> Weights:
        """From a mapping; unknown keys are refused, a table that is given replaces the default's."""
        values = values or {}
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown weights: {', '.join(sorted(unknown))}")
        return cls(**values)


@dataclass(frozen=True)
class Projection:
    """A way to render a pack: when reasons come, and how many tokens by default."""

    name: str
    why: str  # leftover or always
    budget: int


#: No limit.
UNLIMITED = (1 << 32) // 4 - 1
# Names, aliases and budgets of the projections.
PROJECTIONS = {
    "agents-md": Projection("agents-md", "leftover", 700),
    "markdown": Projection("markdown", "leftover", 1500),
    "dossier": Projection("dossier", "always", 4000),
    "prose": Projection("prose", "always", UNLIMITED),
}
PROJECTION_ALIASES = {"agents": "agents-md", "stdout": "markdown", "md": "markdown", "handoff": "prose"}


def projection(name: str) -> Projection:
    name = PROJECTION_ALIASES.get(name, name)
    if name not in PROJECTIONS:
        raise ValueError(f"unknown projection {name!r}: {', '.join(PROJECTIONS)}")
    return PROJECTIONS[name]

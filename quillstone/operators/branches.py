"""The branch graph: validation, inheritance, what a branch holds, and the pool of claims it sees."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BRANCH_NAME
from ..model import KINDS

# Templates of new branches (holds, kinds that flow from the parent, budget, projection).
TEMPLATES = {
    "research": (["fact", "question", "claim", "rejected", "decision", "constraint"], ["decision", "fact"], 1200, "dossier"),
    "code": (["decision", "constraint", "rejected", "question", "fact"], ["decision", "constraint", "rejected"], 700, "agents-md"),
    "gtm": (["claim", "decision", "rejected", "question"], ["decision", "claim", "constraint"], 900, "prose"),
    "writing": (["claim", "fact", "decision", "rejected", "question"], ["decision", "fact", "claim"], 1500, "dossier"),
}
FIELDS = {"parent", "holds", "inherits", "budget", "compile", "binds", "pins", "archived"}
POOL = "branch string, source string, kinds array<string>"


class BranchError(ValueError):
    pass


def template(name: str, parent: str | None = None) -> dict:
    if name not in TEMPLATES:
        raise BranchError(f"no template {name!r}: {', '.join(TEMPLATES)}")
    holds, flow, budget, compiled = TEMPLATES[name]
    return {"parent": parent, "holds": list(holds), "inherits": {parent: list(flow)} if parent else {}, "budget": budget, "compile": compiled}


@dataclass
class Branches:
    """Definitions by project and branch name: {project: {name: {parent, holds, inherits, ...}}}."""

    projects: dict = field(default_factory=dict)

    def get(self, branch: str) -> dict | None:
        project, _, name = branch.partition("/")
        return self.projects.get(project, {}).get(name) if name else None

    def all(self) -> list[str]:
        return sorted(f"{p}/{b}" for p, bs in self.projects.items() for b in bs)

    @staticmethod
    def qualify(branch: str, name: str) -> str:
        """A name as written in a definition of ``branch``'s project."""
        return name if "/" in name else f"{branch.partition('/')[0]}/{name}"

    def targets(self, branch: str) -> set[str]:
        d = self.get(branch) or {}
        return {self.qualify(branch, t) for t in [*(d.get("inherits") or {}), *([d["parent"]] if d.get("parent") else [])]}

    def validate(self) -> Branches:
        """Names and fields are known, each edge ends at a defined branch, and there is no cycle."""
        names = self.all()
        for branch in names:
            d = self.get(branch) or {}
            if branch.count("/") != 1 or not BRANCH_NAME.fullmatch(branch):
                raise BranchError(f"invalid branch name {branch!r}")
            if set(d) - FIELDS:
                raise BranchError(f"{branch}: unknown fields {sorted(set(d) - FIELDS)}")
            for kind in [*(d.get("holds") or []), *(k for ks in (d.get("inherits") or {}).values() for k in ks)]:
                if kind not in KINDS:
                    raise BranchError(f"{branch}: unknown kind {kind!r}")
        edges = {b: self.targets(b) for b in names}
        for branch, targets in edges.items():
            if missing := targets - set(names):
                raise BranchError(f"{branch}: unknown branch {sorted(missing)[0]!r}")
        left = dict(edges)
        while left:  # branches whose targets are all done are done
            done = [b for b, t in left.items() if not t & set(left)]
            if not done:
                raise BranchError(f"cycle among {', '.join(sorted(left))}")
            for b in done:
                del left[b]
        return self

    def insert(self, branch: str, definition: dict) -> Branches:
        """The graph with one branch more; this one is left as it is if that would be invalid."""
        project, _, name = branch.partition("/")
        if self.get(branch) is not None:
            raise BranchError(f"{branch} exists")
        merged = {p: dict(bs) for p, bs in self.projects.items()}
        merged.setdefault(project, {})[name] = definition
        return Branches(merged).validate()

    def pool_sources(self, branch: str) -> dict[str, list[str] | None]:
        """Where a branch's claims come from, and which kinds (None: all).

        Its own claims; those of each ancestor in the kinds that every hop lets through; and those of
        lateral branches, one hop, in the kinds listed. An undefined branch sees itself alone.
        """
        granted: dict[str, set | None] = {branch: None}

        def grant(source: str, kinds: set) -> None:
            if kinds and granted.get(source, set()) is not None:
                granted[source] = granted.get(source, set()) | kinds

        d = self.get(branch)
        if d is not None:
            for name, kinds in (d.get("inherits") or {}).items():
                if name != d.get("parent"):
                    grant(self.qualify(branch, name), set(kinds))
            allowed, at, walked = set(d.get("holds") or KINDS), branch, {branch}
            while d and d.get("parent"):
                above = self.qualify(at, d["parent"])
                if above in walked:
                    break
                walked.add(above)
                scope = (d.get("inherits") or {}).get(d["parent"])
                allowed = allowed if scope is None else allowed & set(scope)
                grant(above, allowed)
                at, d = above, self.get(above)
        return {s: None if k is None else [x for x in KINDS if x in k] for s, k in sorted(granted.items())}

    def pool_table(self, spark: SparkSession, branches: list[str] | None = None) -> DataFrame:
        """(branch, source, kinds) of the given or all branches: as many rows as the configuration has edges."""
        rows = [(b, s, k) for b in (self.all() if branches is None else branches) for s, k in self.pool_sources(b).items()]
        return spark.createDataFrame(rows, POOL)

    def holds(self, branch: str, kind: str) -> bool:
        d = self.get(branch)
        return d is None or not d.get("holds") or kind in d["holds"]

    def holder(self, branch: str, kind: str) -> str | None:
        """The first live branch of the same project that holds ``kind``."""
        project = branch.partition("/")[0]
        return next((f"{project}/{n}" for n, d in sorted(self.projects.get(project, {}).items()) if not (d or {}).get("archived") and self.holds(f"{project}/{n}", kind)), None)

    def check_holds(self, branch: str, kind: str) -> None:
        if not self.holds(branch, kind):
            other = self.holder(branch, kind)
            raise BranchError(f"{branch} does not hold {kind}" + (f"; {other} does" if other else ""))

    def holds_table(self, spark: SparkSession) -> DataFrame:
        """(branch, kind, suggestion) for each kind that a defined branch refuses."""
        rows = [(b, k, self.holder(b, k)) for b in self.all() for k in KINDS if not self.holds(b, k)]
        return spark.createDataFrame(rows, "branch string, kind string, suggestion string")


def pool(claims: DataFrame, sources: DataFrame, statuses: tuple[str, ...] = ("active", "superseded")) -> DataFrame:
    """The claims each branch sees: (for_branch, claim columns). ``sources`` is a configuration table."""
    scoped = F.broadcast(sources.select(F.col("branch").alias("for_branch"), F.col("source").alias("branch"), F.col("kinds").alias("_kinds")))
    rows = claims.where(F.col("status").isin(*statuses)).join(scoped, "branch")
    return rows.where(F.col("_kinds").isNull() | F.array_contains("_kinds", F.col("kind"))).drop("_kinds")


def holds_violations(claims: DataFrame, refused: DataFrame) -> DataFrame:
    """Claims of a kind that their branch refuses, with a branch that would hold them."""
    return claims.join(F.broadcast(refused), ["branch", "kind"])


def find_docs(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """The document each branch sees under a name: its own, else the first source's, else the project's newest."""
    own = docs.withColumnRenamed("branch", "doc_branch")
    ordered = sources.select(F.col("branch").alias("for_branch"), F.col("source").alias("doc_branch"), F.when(F.col("source") == F.col("branch"), 0).otherwise(1).alias("priority"))
    seen = own.join(F.broadcast(ordered), "doc_branch")
    wanted = sources.select(F.col("branch").alias("for_branch")).distinct()
    project = F.split_part(F.col("doc_branch"), F.lit("/"), F.lit(1)) == F.split_part(F.col("for_branch"), F.lit("/"), F.lit(1))
    newest = own.join(F.broadcast(wanted), project).withColumn("priority", F.lit(2))
    rows = seen.unionByName(newest)
    others = [c for c in own.columns if c != "name"]
    # a source's place by name; among a project's documents the newest id
    first = F.min_by(F.struct(*others, "priority"), F.struct("priority", "doc_branch"))
    last = F.max_by(F.struct(*others, "priority"), "id")
    picked = rows.groupBy("for_branch", "name").agg(F.min("priority").alias("p"), first.alias("a"), last.alias("b"))
    chosen = F.when(F.col("p") == 2, F.col("b")).otherwise(F.col("a"))
    return picked.select("for_branch", "name", chosen.alias("v")).select("for_branch", "name", *[F.col(f"v.{c}").alias(c) for c in others], F.col("v.priority").alias("priority"))

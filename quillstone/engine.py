"""One object with the verbs of the engine over a home folder, returning DataFrames."""

from __future__ import annotations

import datetime as dt
import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship
from .functions.canonical import claim_address, content, document_address, merkle_roots, normalize_text, with_address
from .functions.files import new_id, resolve_branch, write_if_changed
from .functions.render import index_text
from .model import CONFIDENCES, DEFAULT_BRANCH, KINDS, STATUS_RANK, Weights
from .operators import index, listing, mutations, packer, views
from .operators.branches import Branches, find_docs, pool, template
from .sources import config, log
from .sources.shared import fresh_folder
from .streaming.kept import KeptView


class Engine:
    """``home`` holds log/, branches.yaml and weights.yaml; ``machine`` names this writer's shards.

    With a folder ``view`` the engine keeps its view there: a read takes the records that are new since the last one. Without, it
    reads the log as a whole after each write.
    """

    def __init__(self, spark: SparkSession, home: str, machine: str = "local", branch: str | None = None, view: str | None = None):
        ship(spark)
        self.kept = KeptView(spark, home, view) if view else None
        self._fresh = False
        self.spark, self.home, self.machine = spark, home, machine
        self.branches = Branches(config.load_branches(os.path.join(home, "branches.yaml")))
        self.weights: Weights = config.load_weights(os.path.join(home, "weights.yaml"))
        bound = config.find_binding(home) or {}
        self.branch = branch or bound.get("branch") or self.active() or DEFAULT_BRANCH
        self._last: str | None = None

    # --- views -----------------------------------------------------------------

    def refresh(self) -> Engine:
        """Forget the views: the next use reads the log again."""
        for name in ("records", "claims", "docs", "tokens"):
            self.__dict__.pop(name, None)
        self._fresh = False
        return self

    @cached_property
    def records(self) -> log.Records:
        return self._caught_up().records() if self.kept else log.read(self.spark, self.home)

    def _caught_up(self) -> KeptView:
        """The kept view, brought up to date once after each write."""
        if not self._fresh:
            self.kept.catch_up()
            self._fresh = True
        return self.kept

    @cached_property
    def claims(self) -> DataFrame:
        if self.kept:
            return self._caught_up().claims()
        r = self.records
        counters = views.unique_records(r.counters)
        both = counters.select("id", "claim", "machine", F.col("helpful").cast("long").alias("helpful"), F.col("harmful").cast("long").alias("harmful")).unionByName(views.inline_counters(r.claims))
        return views.hydrate(views.unique_records(r.claims), views.unique_records(r.statuses), both)

    @cached_property
    def docs(self) -> DataFrame:
        if self.kept:
            return self._caught_up().docs()
        return views.current_docs(views.unique_records(self.records.docs), views.unique_records(self.records.statuses))

    @cached_property
    def tokens(self) -> DataFrame:
        return index.token_table(self.claims).persist()

    def register_views(self) -> None:
        """Temporary views claims, status_changes, counters, docs, edges for SQL."""
        r = self.records
        self.claims.createOrReplaceTempView("claims")
        views.unique_records(r.statuses).createOrReplaceTempView("status_changes")
        views.counter_state(r.counters).createOrReplaceTempView("counters")
        self.docs.createOrReplaceTempView("docs")
        self.claims.where("supersedes IS NOT NULL").select(F.col("id").alias("src"), F.col("supersedes").alias("dst"), F.lit("supersedes").alias("kind")).createOrReplaceTempView("edges")

    def names(self) -> list[str]:
        rows = self.claims.select("branch").union(self.docs.select("branch")).distinct().collect()
        return sorted({*(r["branch"] for r in rows), *self.branches.all()})

    def resolve_branch(self, name: str | None) -> str:
        return resolve_branch(name, self.names(), self.branch)

    # --- reading ---------------------------------------------------------------

    def scan(self, **filters) -> DataFrame:
        return views.scan(self.claims, **filters)

    def get(self, prefix: str) -> DataFrame:
        return views.resolve(self.claims, prefix)

    def search(self, words: str, limit: int = 50, include_archived: bool = False, **filters) -> DataFrame:
        return index.search(self.tokens, views.scan(views.visible(self.claims, include_archived), **filters), words, limit)

    def neighbors(self, ids: list[str], limit: int = 50) -> DataFrame:
        return index.neighbors(self.claims, self.spark.createDataFrame([(i,) for i in ids], "id string"), limit)

    def pool(self, branch: str | None = None) -> DataFrame:
        return pool(self.claims, self.branches.pool_table(self.spark, [branch or self.branch]))

    def find_doc(self, name: str, branch: str | None = None) -> DataFrame:
        return find_docs(self.docs, self.branches.pool_table(self.spark, [branch or self.branch])).where(F.col("name") == name)

    def pack(self, branch: str | None = None, projection: str | None = None, budget: int | None = None, task: str | None = None) -> DataFrame:
        """The pack of a branch. The branch's budget holds if the projection is its own, else the projection's."""
        branch = branch or self.branch
        d = self.branches.get(branch) or {}
        own = d.get("compile") or "agents-md"
        projection = projection or own
        if budget is None and projection == own:
            budget = d.get("budget")
        sources = self.branches.pool_table(self.spark, [branch])
        pins = None
        if d.get("pins"):
            wanted = self.spark.createDataFrame([(branch, p) for p in d["pins"]], "for_branch string, pin string")
            pins = packer.resolve_pins(self.claims, wanted)
        ranks = index.task_relevance(self.tokens, self.claims, pool(self.claims, sources), task) if task and task.strip() else None
        return packer.packs(self.claims, sources, projection, budget, self.weights, ranks, pins, self.generation())

    def write_packs(self, folder: str) -> list[str]:
        """A dossier of each live branch, written where it changed; files of other branches go."""
        live = [b for b in self.branches.all() if not (self.branches.get(b) or {}).get("archived")]
        made = packer.packs(self.claims, self.branches.pool_table(self.spark, live), "dossier", None, self.weights)
        written, wanted = [], set()
        for r in made.select("for_branch", "markdown").toLocalIterator():
            path = os.path.join(folder, f"{r['for_branch']}.md")
            wanted.add(path)
            if write_if_changed(path, r["markdown"]):
                written.append(path)
        for top, _, names in os.walk(folder):
            for name in names:
                if name.endswith(".md") and os.path.join(top, name) not in wanted:
                    os.remove(os.path.join(top, name))
        return written

    def index(self, budget: int = 250) -> str:
        rows = listing.overview(views.branch_summary(self.claims), listing.defined_table(self.spark, self.branches)).where("note IS NULL OR note <> 'archived'")
        ordered = rows.orderBy(F.desc_nulls_last("last"), "branch").limit(budget)  # a line is a token at least
        return index_text([(r["branch"], r["active"], r["proposed"], r["last"] and f"{r['last']:%Y-%m-%d}", r["note"]) for r in ordered.collect()], self.branch, budget)

    def generation(self) -> str | None:
        r = self.records
        return views.generation(r.claims, r.statuses, r.counters, r.docs).first()["generation"]

    def stats(self) -> DataFrame:
        return views.stats(self.claims)

    def state_root(self, branch: str | None = None) -> DataFrame:
        return merkle_roots(self.pool(branch).where("status = 'active'"), ["for_branch"])

    def verify(self, root: str, branch: str | None = None) -> DataFrame:
        return listing.verify(self.pool(branch).where("status = 'active'"), root)

    def standing(self, root: str, branch: str | None = None) -> str:
        """Whether a pool with ``root`` is in sync with the log, behind it by so many claims, or ahead or diverged."""
        return listing.verdict(self.verify(root, branch))

    def unseen(self, pack: str, branch: str | None = None) -> DataFrame:
        """Live claims of a branch that a pack's text doesn't show."""
        return listing.unseen(self.claims, pack, branch or self.branch)

    def refine(self, threshold: float = 0.5) -> DataFrame:
        return listing.refine(views.visible(self.claims), threshold)

    def map(self) -> DataFrame:
        shown = listing.stations(views.visible(self.claims))
        return listing.map_text(shown, listing.station_links(shown, self.claims))

    def ideas(self) -> DataFrame:
        return listing.ideas(views.branch_summary(self.claims), self.docs, listing.defined_table(self.spark, self.branches))

    # --- writing ---------------------------------------------------------------

    def _append(self, record: dict) -> dict:
        at = dt.datetime.now(dt.timezone.utc)
        self._last = new_id(at.timestamp(), self._last)
        whole = {"rec": record.pop("rec"), "id": self._last, **record, "t_tx": at.isoformat()}
        log.append(self.home, self.machine, whole, at)
        self.refresh()
        return whole

    def save(self, kind: str, text: str, why: str | None = None, refs=(), entities=(), branch: str | None = None, supersedes: str | None = None, confidence: str = "medium", src: str = "api", proposed: bool = False) -> dict:
        """Record a claim; the one that exists is returned if its content is on the branch already."""
        branch, kind = branch or self.branch, kind.lower()
        if kind not in KINDS or confidence not in CONFIDENCES:
            raise ValueError(f"unknown kind or confidence: {kind}, {confidence}")
        self.branches.check_holds(branch, kind)
        if supersedes is not None and not proposed and not self.claims.where(F.col("id") == supersedes).limit(1).count():
            raise ValueError(f"no claim {supersedes} to supersede")
        fields = content(kind, text, why, refs, entities)
        if not fields["text"].strip():
            raise ValueError("empty text")
        cid = claim_address(kind, text, why, refs, entities)
        same = self.claims.where((F.col("cid") == cid) & (F.col("branch") == branch))
        found = (same if proposed else same.where("status <> 'archived'")).orderBy("id").limit(1).collect()
        if found:
            return {"outcome": "duplicate", "id": found[0]["id"], "cid": cid}
        made = self._append({"rec": "claim", "cid": cid, "branch": branch, **fields, "supersedes": None if proposed else supersedes, "status": "proposed" if proposed else "active", "confidence": confidence, "src": src, "tokens": -(-len(fields["text"]) // 4)})
        return {"outcome": "saved", "id": made["id"], "cid": cid}

    def propose(self, kind: str, text: str, branch: str, **more) -> dict:
        return self.save(kind, text, branch=branch, proposed=True, **more)

    def find_one(self, prefix: str) -> str:
        """The id of the only record that ``prefix`` names."""
        found = [r["id"] for r in self.get(prefix).select("id").collect()]  # 20 at most
        if len(found) != 1:
            raise ValueError(f"{prefix!r} names {'several claims: ' + ', '.join(found) if found else 'no claim'}")
        return found[0]

    def transition(self, claim: str, to: str, reason: str | None = None, src: str = "api") -> dict:
        if to not in STATUS_RANK:
            raise ValueError(f"unknown status {to!r}")
        return self._append({"rec": "status", "claim": claim, "to": to, "reason": reason, "src": src})

    def review(self, claim: str, accept: bool) -> dict:
        if self.claims.where((F.col("id") == claim) & (F.col("status") == "proposed")).count() != 1:
            raise ValueError(f"{claim} is not a proposal")
        return self.transition(claim, "active" if accept else "rejected", "review")

    def rate(self, claim: str, helpful: bool) -> dict:
        own = views.counter_state(self.records.counters).where((F.col("claim") == claim) & (F.col("machine") == self.machine)).collect()
        counts = {"helpful": own[0]["helpful"] if own else 0, "harmful": own[0]["harmful"] if own else 0}
        counts["helpful" if helpful else "harmful"] += 1
        return self._append({"rec": "counter", "claim": claim, "machine": self.machine, **counts})

    def save_doc(self, name: str, body: str, title: str | None = None, branch: str | None = None, src: str = "api") -> dict:
        """A new version of a document, unless the current one has the same body."""
        branch = branch or self.branch
        row = self.spark.createDataFrame([(branch, name, title, body)], "branch string, name string, title string, body string")
        made = mutations.save_docs(row, self.docs.select("branch", "name", "cid")).first()
        if made["outcome"] != "saved":
            return {"outcome": made["outcome"], "error": made["error"]}
        self._append({"rec": "doc", "branch": branch, "name": made["name"], "title": made["title"], "body": normalize_text(body), "cid": document_address(normalize_text(body)), "src": src})
        return {"outcome": "saved", "cid": made["cid"]}

    def merge(self, source: str, target: str) -> int:
        """Record copies of the source's active claims on the target, each with a reference to its original; those merged
        before, and kinds that the target refuses, are left out. The number of copies."""
        at = dt.datetime.now(dt.timezone.utc)
        rows = mutations.merge_branch(self.claims, source, target, self.branches.holds_table(self.spark))
        n = rows.count()
        log.write(self._claim_records(rows, F.lit(at), "merge"), self.home, self.machine, "t_tx")
        self.refresh()
        return n

    def rename_project(self, old: str, new: str) -> int:
        """Carry a project's live claims, all its visible document versions and its definitions over to another name, and archive the originals.

        The new name must not be in use. All records go to the log in one write, so a reader sees all of them or none; the
        definitions follow. If a run has ended in between, another one finishes it. The number of claims that were carried.
        """
        if not old or not new or "/" in new:
            raise ValueError(f"{new!r} is no name")
        docs = views.visible_docs(views.unique_records(self.records.docs), self.records.statuses)
        live = [b for b in (*self._branches_of(views.visible(self.claims)), *self._branches_of(docs)) if b.split("/")[0] == old]
        if any(b.split("/")[0] == new for b in self.names()):
            if live or new in self.branches.projects or old not in self.branches.projects:
                raise ValueError(f"{new!r} is in use")
            self._carry_definitions(old, new)  # an earlier run has written the records
            return 0
        at = F.lit(dt.datetime.now(dt.timezone.utc))
        mine = self.claims.where((F.split("branch", "/")[0] == old) & (F.col("status") != "archived"))
        fresh = mutations.numbered(mine.select("id"), at, fresh_folder(self.spark, "ids"))
        rows = mutations.rename_project(mine.join(fresh, "id"), old, new, F.col("fresh"))
        made = self._claim_records(rows, at, "rename")
        moved = docs.where(F.split("branch", "/")[0] == old)
        docs_made = self._in_order(moved.select(F.lit("doc").alias("rec"), F.lit("").alias("id"), F.concat(F.lit(f"{new}/"), F.element_at(F.split("branch", "/"), -1)).alias("branch"), "name", "title", "body", "cid", F.lit("rename").alias("src"), at.alias("t_tx"), F.col("id").alias("version")), at)
        gone = mutations.remove_project(self.claims, docs, old, at)
        everything = made.unionByName(docs_made, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)
        log.write(everything, self.home, self.machine, "t_tx")
        self._carry_definitions(old, new)
        self.refresh()
        return fresh.count()

    def _in_order(self, docs: DataFrame, at) -> DataFrame:
        """Documents with new ids in the order of ``version``: ranges of it are numbered one after another."""
        folder = fresh_folder(self.spark, "ids")
        ordered = docs.repartitionByRange("version").sortWithinPartitions("version")
        ordered.withColumn("id", mutations.time_id(at)).drop("version").write.parquet(folder)
        return self.spark.read.schema(docs.drop("version").schema).parquet(folder)

    def _branches_of(self, rows: DataFrame) -> list[str]:
        return [r["branch"] for r in rows.select("branch").distinct().collect()]

    # --- definitions -------------------------------------------------------------

    def _define(self, projects: dict) -> None:
        config.save_branches(os.path.join(self.home, "branches.yaml"), projects)
        self.branches = Branches(projects)

    def _archived(self, projects: dict, names: list[str]) -> dict:
        """``projects`` with the definitions of these branches marked archived."""
        return {p: {b: {**(d or {}), "archived": True} if f"{p}/{b}" in names else d for b, d in bs.items()} for p, bs in projects.items()}

    def _carry_definitions(self, old: str, new: str) -> None:
        projects = self.branches.projects
        if old not in projects or new in projects:
            return
        there = lambda name: f"{new}/{name.split('/')[1]}" if name and name.startswith(f"{old}/") else name
        carried = {b: {**(d or {}), **({"parent": there(d["parent"])} if (d or {}).get("parent") else {}), **({"inherits": {there(k): v for k, v in d["inherits"].items()}} if (d or {}).get("inherits") else {})} for b, d in projects[old].items()}
        self._define({**self._archived(projects, [f"{old}/{b}" for b in projects[old]]), new: carried})

    def new_branch(self, branch: str, kind: str = "research", parent: str | None = None) -> dict:
        """Define a branch from a template; its parent, if it has one, is a branch of the same project or a qualified one."""
        self._define(self.branches.insert(branch, template(kind, parent)).projects)
        return self.branches.get(branch)

    def ensure_project(self, name: str) -> bool:
        """Define a project's research branch unless the project is defined; whether it is new."""
        if name in self.branches.projects:
            return False
        self.new_branch(f"{name}/research")
        return True

    def set_active(self, branch: str) -> None:
        """Make ``branch`` the one that is used where none is named, now and by later engines over this home."""
        branch = self.resolve_branch(branch)
        os.makedirs(os.path.join(self.home, "refs"), exist_ok=True)
        write_if_changed(os.path.join(self.home, "refs", "active"), branch + "\n")
        self.branch = branch

    def active(self) -> str | None:
        """The branch that was made active, if any."""
        path = os.path.join(self.home, "refs", "active")
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as f:
            return f.read().strip() or None

    def archive_branch(self, branch: str) -> int:
        """Archive the live claims of a branch and mark its definition; its documents stay. The number of claims."""
        rows = mutations.archive_branch(self.claims, branch, F.lit(dt.datetime.now(dt.timezone.utc)))
        n = rows.count()
        log.write(rows, self.home, self.machine, "t_tx")
        if self.branches.get(branch) is not None:
            self._define(self._archived(self.branches.projects, [branch]))
        self.refresh()
        return n

    def _claim_records(self, rows: DataFrame, stamp, src: str) -> DataFrame:
        """The log records of claims that a mutation made (column ``origin``: what they were made of), addressed anew."""
        made = with_address(rows if src == "rename" else rows.withColumn("id", mutations.time_id(stamp)))
        chain = F.col("supersedes") if src == "rename" else F.lit(None).cast("string").alias("supersedes")
        return made.select(F.lit("claim").alias("rec"), "id", "cid", "kind", "branch", "text", "why", "refs", "entities", chain, "status", "confidence", F.lit(src).alias("src"), "t_valid", stamp.alias("t_tx"))

    def remove(self, branch: str) -> tuple[int, int]:
        """Archive all live claims and document versions of a branch: nothing is erased. The numbers of claims and of documents."""
        return self._remove(lambda b: b == branch)

    def remove_project(self, name: str) -> tuple[int, int]:
        """Archive all live claims and document versions of a project's branches."""
        return self._remove(lambda b: F.split(b, "/")[0] == name)

    def _remove(self, of) -> tuple[int, int]:
        docs = views.visible_docs(self.records.docs, self.records.statuses)
        mine = of(F.col("branch"))
        counts = mutations.removal_counts(self.claims, docs).where(mine).collect()  # a row a branch
        rows = mutations.removal(self.claims, docs).where(mine)
        at = F.lit(dt.datetime.now(dt.timezone.utc))
        log.write(mutations.transitions(rows, "archived", F.concat(F.lit("branch "), "branch", F.lit(" removed")), "api", at), self.home, self.machine, "t_tx")
        gone = [b for b in self.branches.all() if b in {r["branch"] for r in counts}]
        if gone:
            self._define(self._archived(self.branches.projects, gone))
        self.refresh()
        return sum(r["claims"] for r in counts), sum(r["docs"] for r in counts)

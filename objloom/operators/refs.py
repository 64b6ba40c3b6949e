"""References: (name, kind, target_id, target_name), their transactions and batches."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from heapq import heappop, heappush
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from objloom.functions import refnames as N
from objloom.operators.graph import resolve_chains

KINDS = ("create", "update", "delete", "verify", "create-symbolic", "update-symbolic", "delete-symbolic", "verify-symbolic")


def visible(loose: DataFrame, packed: DataFrame, key: str = "name") -> DataFrame:
    """Loose references over packed ones; lock files aren't references."""
    rest = [c for c in loose.columns if c != key]
    a, b = loose.withColumn("_l", F.lit(True)).alias("a"), packed.alias("b")
    both = a.join(b, key, "full")
    return both.select(key, *[F.when(F.col("a._l"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in rest]).where(~F.col(key).endswith(".lock"))


def all_names(head: DataFrame, common: DataFrame, worktree: DataFrame, packed: DataFrame, key: str = "name") -> DataFrame:
    """Every visible name: HEAD where it is there, loose names of the common folder and of the worktree, and packed ones; lock files aren't names."""
    out = head.select(key)
    for part in (common.where(~F.col(key).endswith(".lock")), worktree.where(~F.col(key).endswith(".lock")), packed):
        out = out.unionByName(part.select(key))
    return out.distinct()


def survivors(packed: DataFrame, deleted: DataFrame, key: str = "name") -> DataFrame:
    """The packed references that a rewrite keeps."""
    return packed.join(deleted.select(key).distinct(), key, "left_anti")


def chained(stores: list[DataFrame]) -> DataFrame:
    """(name, kind, target_id, target_name, backend) of the first store that has each name; symbolic hops go through the whole chain by resolve_symbolic."""
    from objloom.operators.stores import chained as first

    own = ["name", "kind", "target_id", "target_name"]
    return first([s.select(own) for s in stores], ["name"]).withColumnRenamed("priority", "backend").select(*own, "backend")


def resolve_symbolic(refs: DataFrame) -> DataFrame:
    """(name, terminal, target_id, error) of every reference: ErrSymbolicCycle, ErrReferenceNotFound or ErrInvalidValue."""
    links = refs.where("kind = 'symbolic'").select(F.col("name").alias("node"), F.col("target_name").alias("next"))
    chains = resolve_chains(links).select(F.col("node").alias("name"), "terminal", "cycle")
    direct = refs.where("kind = 'direct'").select(F.col("name").alias("terminal"), "target_id")
    out = refs.select("name").join(chains, "name", "left").withColumn("terminal", F.when(F.coalesce("cycle", F.lit(False)), None).otherwise(F.coalesce("terminal", "name"))).join(direct, "terminal", "left")
    error = F.when(F.col("cycle"), "ErrSymbolicCycle").when(F.col("terminal") == "", "ErrInvalidValue").when(F.col("target_id").isNull(), "ErrReferenceNotFound")
    return out.select("name", "terminal", "target_id", error.alias("error"))


def conflicts(names: DataFrame, others: DataFrame, name: str = "name") -> DataFrame:
    """(name, other) where one is a path prefix of the other.

    An equi-join of names with the exploded proper prefixes of the other side,
    both ways; a comparison of all pairs would be a nested loop.
    """
    a, b = names.select(F.col(name).alias("name")).distinct(), others.select(F.col(name).alias("other")).distinct()
    above = a.withColumn("p", F.explode(N.prefixes(F.col("name")))).join(b, F.col("p") == F.col("other")).select("name", "other")
    below = b.withColumn("p", F.explode(N.prefixes(F.col("other")))).join(a, F.col("p") == F.col("name")).select("name", "other")
    return above.unionAll(below).distinct()


def validated(updates: DataFrame) -> DataFrame:
    """updates with ``invalid``: what an operation is refused for when it is queued."""
    name, kind, target = F.col("name"), F.col("kind"), F.col("new_target")
    writes, symbolic = kind.isin("create", "update", "create-symbolic", "update-symbolic"), kind.endswith("-symbolic")
    return updates.withColumn(
        "invalid",
        F.when(~N.can_update(name, writes), "ErrInvalidName")
        .when(symbolic & writes & (F.coalesce(target, F.lit("")) == ""), "ErrInvalidValue")
        .when(symbolic & writes & ~N.can_point_to(name, target), "ErrInvalidName")
        .when(symbolic & (kind != "create-symbolic") & (F.coalesce("old_target", F.lit("")) == ""), "ErrInvalidValue"),
    )


def prepared(refs: DataFrame, updates: DataFrame) -> DataFrame:
    """updates with their target name and ``error``/``phase`` of preparing them all together.

    Phase 1 resolves targets (and finds two operations on one), 2 finds name
    conflicts, 4 compares old values.  The first error of a transaction is that
    of the least (phase, seq).
    """
    known = refs.select("name", F.col("kind").alias("ref_kind"), "target_id", "target_name")
    ends = resolve_symbolic(refs).select("name", "terminal", F.col("error").alias("chain_error"))
    plain = ~F.col("kind").endswith("-symbolic")
    ops = updates.join(ends, "name", "left").withColumn("target", F.when(plain, F.coalesce("terminal", "name")).otherwise(F.col("name")))
    lost = F.col("terminal").isNull() | (F.col("chain_error") == "ErrReferenceNotFound")
    ops = ops.withColumn("resolve", F.when(plain, F.when(F.col("chain_error").isin("ErrSymbolicCycle", "ErrInvalidValue"), F.col("chain_error")).when(lost & (F.col("kind") != "create"), "ErrReferenceNotFound")))
    again = F.row_number().over(W.partitionBy("target", F.col("resolve").isNull()).orderBy("seq"))
    ops = ops.withColumn("phase1", F.coalesce("resolve", F.when(again > 1, "ErrDuplicateUpdate")))
    writes = ops.where(F.col("kind").isin("create", "update", "create-symbolic", "update-symbolic")).select(F.col("target").alias("name")).distinct()
    gone = ops.where(F.col("kind").isin("delete", "delete-symbolic")).select(F.col("target").alias("name")).distinct()
    there = known.select("name").join(gone, "name", "left_anti").unionByName(writes).distinct()
    clash = conflicts(writes, there).groupBy("name").agg(F.min("other").alias("conflict")).withColumnRenamed("name", "target")
    ops = ops.join(clash, "target", "left").join(known.withColumnRenamed("name", "target"), "target", "left")
    writing = F.col("kind").isin("create", "update", "create-symbolic", "update-symbolic")
    kind, have = F.col("kind"), F.col("ref_kind")
    old = (
        F.when(kind.startswith("create"), F.when(have.isNotNull(), "ErrCreateExists"))
        .when(have.isNull(), "ErrReferenceNotFound")
        .when(plain, F.when(have != "direct", "ErrExpectedDirect").when(~F.col("target_id").eqNullSafe(F.col("old_id")), "WrongOldIDError"))
        .otherwise(F.when(have != "symbolic", "ErrExpectedSymbolic").when(~F.col("target_name").eqNullSafe(F.col("old_target")), "WrongOldTargetError"))
    )
    error = F.when(F.col("phase1").isNotNull(), F.col("phase1")).when(writing & F.col("conflict").isNotNull(), "NameConflictError").otherwise(old)
    phase = F.when(F.col("phase1").isNotNull(), 1).when(writing & F.col("conflict").isNotNull(), 2).when(old.isNotNull(), 4)
    return ops.select(*updates.columns, "target", error.alias("error"), phase.alias("phase"))


def commit(refs: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references after an atomic transaction, and its first error (no rows if there is none, else references stay)."""
    ops = prepared(refs, updates)
    first = ops.where("error IS NOT NULL").agg(F.min_by(F.struct("seq", "name", "error", "phase"), F.struct("phase", "seq")).alias("e")).where("e IS NOT NULL").select("e.*")
    if not first.isEmpty():
        return refs, first
    symbolic = F.col("op").endswith("-symbolic")
    new = ops.where(~F.col("kind").startswith("verify")).select(F.col("target").alias("name"), F.col("kind").alias("op"), "new_id", "new_target")
    after = refs.join(new, "name", "full").where(~F.coalesce(F.col("op").startswith("delete"), F.lit(False)))
    kept = F.col("op").isNull()
    return after.select(
        "name", F.when(kept, F.col("kind")).when(symbolic, "symbolic").otherwise("direct").alias("kind"),
        F.when(kept, F.col("target_id")).when(~symbolic, F.col("new_id")).alias("target_id"), F.when(kept, F.col("target_name")).when(symbolic, F.col("new_target")).alias("target_name"),
    ), first


# -- batches: one operation is refused in each round, so a store's batch is sequential


class Op(NamedTuple):
    """An operation of a batch."""

    name: str
    kind: str
    new_id: str | None
    old_id: str | None
    new_target: str | None
    old_target: str | None


def _above(name: str) -> list[str]:
    """The proper path prefixes of a name."""
    parts = name.split("/")
    return ["/".join(parts[:i]) for i in range(1, len(parts))]


def _count(counts: dict[str, int], key: str, n: int) -> None:
    if left := counts.get(key, 0) + n:
        counts[key] = left
    else:
        counts.pop(key, None)


class _Names:
    """A multiset of names that tells in a few look-ups whether a name is a proper prefix of one or has one as its prefix."""

    def __init__(self, names) -> None:
        self.own, self.above = {}, {}
        for n in names:
            self.add(n)

    def add(self, name: str, n: int = 1) -> None:
        _count(self.own, name, n)
        for p in _above(name):
            _count(self.above, p, n)

    def conflicts(self, name: str) -> bool:
        if name in self.above:
            return True
        at = name.find("/")
        while at >= 0:
            if name[:at] in self.own:
                return True
            at = name.find("/", at + 1)
        return False


def _writes(op) -> bool:
    return op.kind.startswith(("create", "update"))


class _Store:
    """A store's references, for batches one after another: a batch costs what its own operations touch, not what the store holds."""

    def __init__(self, refs: dict[str, tuple[str, str]]) -> None:
        self.refs, self.names = refs, _Names(refs)

    def target(self, op, ends: dict | None = None) -> tuple[str | None, str | None]:
        """Target name, or an error.  ``ends`` keeps where chains end, for as long as the references stay."""
        if op.kind.endswith("-symbolic"):
            return op.name, None
        if (got := self.refs.get(op.name)) and got[0] == "direct":  # as most are
            return op.name, None
        ends = {} if ends is None else ends
        cur, seen = op.name, set()
        while True:
            if end := ends.get(cur):
                break
            got = self.refs.get(cur)
            if not got or got[0] != "symbolic":
                end = (cur, got is not None, None)
                break
            seen.add(cur)
            cur = got[1]
            if cur == "" or cur in seen:
                end = (None, False, "ErrSymbolicCycle" if cur else "ErrInvalidValue")
                break
        for name in seen:
            ends[name] = end
        name, there, error = end
        return (None, error) if error else (name, None) if there or op.kind == "create" else (None, "ErrReferenceNotFound")

    def old_value(self, op, target: str) -> str | None:
        have = self.refs.get(target)
        if op.kind.startswith("create"):
            return "ErrCreateExists" if have else None
        if not have:
            return "ErrReferenceNotFound"
        want = ("symbolic", op.old_target, "ErrExpectedSymbolic", "WrongOldTargetError") if op.kind.endswith("-symbolic") else ("direct", op.old_id, "ErrExpectedDirect", "WrongOldIDError")
        return want[2] if have[0] != want[0] else want[3] if have[1] != want[1] else None

    def first_error(self, ops: list) -> tuple[str, str] | None:
        """(name, error) of preparing the operations together: an operation's name, or a conflicting target's.  This is a round as it is defined; ``run`` does all rounds of a batch."""
        targets: dict[str, object] = {}
        for op in ops:
            t, e = self.target(op)
            if e or t in targets:
                return op.name, e or "ErrDuplicateUpdate"
            targets[t] = op
        fresh = [t for t, op in targets.items() if _writes(op)]
        gone = [t for t, op in targets.items() if op.kind.startswith("delete") and t in self.refs]
        written = _Names(fresh)
        for t in gone:
            self.names.add(t, -1)
        clash = next((t for t in fresh if self.names.conflicts(t) or written.conflicts(t)), None)
        for t in gone:
            self.names.add(t)
        if clash is not None:
            return clash, "NameConflictError"
        return next(((op.name, e) for t, op in targets.items() if (e := self.old_value(op, t))), None)

    def apply(self, ops: list) -> None:
        """All the operations, on the targets that they have before any of them."""
        ends: dict = {}
        for op, t in [(op, self.target(op, ends)[0]) for op in ops]:
            if op.kind.startswith("delete"):
                if self.refs.pop(t, None):
                    self.names.add(t, -1)
            elif _writes(op):
                if t not in self.refs:
                    self.names.add(t)
                self.refs[t] = ("symbolic", op.new_target) if op.kind.endswith("-symbolic") else ("direct", op.new_id)

    def step(self, op) -> tuple[str, str | None]:
        """(status, error) of an operation on its own, which is applied: a batch of one."""
        t, e = self.target(op)
        if e:
            return "rejected" if e in REJECTED else "fatal", e
        writes = _writes(op)
        if writes and self.names.conflicts(t):
            return "rejected" if t == op.name else "not-attempted", "NameConflictError"
        if e := self.old_value(op, t):
            return "rejected", e
        if writes:
            if t not in self.refs:
                self.names.add(t)
            self.refs[t] = ("symbolic", op.new_target) if op.kind.endswith("-symbolic") else ("direct", op.new_id)
        elif op.kind.startswith("delete"):
            del self.refs[t]
            self.names.add(t, -1)
        return "applied", None

    def run(self, ops: list) -> list[tuple[str, str | None]]:
        """(status, error) of each operation of a batch, which is applied.

        By definition each round prepares what is left and drops the operation
        of the first error, until there is none.  Targets and old values stay
        the same in all rounds; conflicts change only around the one that was
        dropped.  So the store's names are kept as the batch would leave them,
        those written that conflict in a heap by their order, and a round looks
        at its first.  A dropped deletion brings its name back, and with it
        conflicts of names above and below it; nothing else adds any.
        """
        if len(ops) == 1:
            return [self.step(ops[0])]
        out: list[tuple[str, str | None]] = [("not-attempted", None)] * len(ops)
        left, taken, ends = {}, set(), {}  # left: the target of each operation that is left
        for i, op in enumerate(ops):
            t, e = self.target(op, ends)
            if e and e not in REJECTED:
                out[i] = ("fatal", e)
                out[i + 1 :] = [("not-attempted", e)] * (len(ops) - i - 1)
                return out
            if e or t in taken:
                out[i] = ("rejected", e or "ErrDuplicateUpdate")
            else:
                taken.add(t)
                left[i] = t
        fresh = {t: i for i, t in left.items() if _writes(ops[i])}
        change = {i: 1 if t in fresh else -1 for i, t in left.items() if t in fresh or (ops[i].kind.startswith("delete") and t in self.refs)}
        for i, n in change.items():
            self.names.add(left[i], n)
        clashes = [i for t, i in fresh.items() if self.names.conflicts(t)]  # in order, so a heap
        wrong = [(i, e) for i, t in left.items() if (e := self.old_value(ops[i], t))]
        named: dict[str, Iterable[int]] | None = None
        below: dict[str, list[int]] | None = None
        done = 0  # of wrong
        while True:
            while clashes and not (clashes[0] in left and self.names.conflicts(left[clashes[0]])):
                heappop(clashes)
            while done < len(wrong) and wrong[done][0] not in left:
                done += 1
            if clashes:
                name, error = left[clashes[0]], "NameConflictError"
            elif done < len(wrong):
                name, error = ops[wrong[done][0]].name, wrong[done][1]
            else:
                break
            if named is None:  # the operations of each name, the last one first
                named = defaultdict(list)
                for i in reversed(left):
                    named[ops[i].name].append(i)
            own = named.get(name, [])
            while own and own[-1] not in left:
                own.pop()
            if not own:  # a conflicting target that no operation is named after
                for i in left:
                    out[i] = ("not-attempted", error)
                    if i in change:
                        self.names.add(left[i], -change[i])
                return out
            at = own[-1]
            out[at], t = ("rejected", error), left.pop(at)
            if at in change:
                self.names.add(t, -change[at])
                if change[at] < 0:
                    if below is None:
                        below = defaultdict(list)
                        for x, i in fresh.items():
                            for p in _above(x):
                                below[p].append(i)
                    for i in [*(fresh[p] for p in _above(t) if p in fresh), *below.get(t, ())]:
                        if i in left:
                            heappush(clashes, i)
        for i, t in left.items():
            op = ops[i]
            out[i] = ("applied", None)
            if op.kind.startswith("delete"):
                self.refs.pop(t, None)
            elif i in change:
                if t in self.refs:
                    self.names.add(t, -1)  # it was there before
                self.refs[t] = ("symbolic", op.new_target) if op.kind.endswith("-symbolic") else ("direct", op.new_id)
        return out


#: Errors for which an operation is refused; others end the batch.
REJECTED = {"ErrReferenceNotFound", "ErrCreateExists", "ErrDuplicateUpdate", "ErrExpectedDirect", "ErrExpectedSymbolic", "NameConflictError", "WrongOldIDError", "WrongOldTargetError", "ErrSymbolicCycle"}


def run_batch(refs: dict[str, tuple[str, str]], ops: list) -> tuple[list[tuple[str, str | None]], dict]:
    """(status, error) of each operation, and the references after the batch."""
    store = _Store(dict(refs))
    return store.run(ops), store.refs


def batch(refs: DataFrame, updates: DataFrame) -> DataFrame:
    """(store, seq, name, status, error) of each store's batch; stores run apart, each in order of seq."""

    def run(key, ops: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        columns = (own[c].tolist() for c in ("name", "kind", "target_id", "target_name"))
        known = {name: (kind, target if kind == "symbolic" else target_id) for name, kind, target_id, target in zip(*columns, strict=True)}
        ops = ops.sort_values("seq", kind="stable")
        got = _Store(known).run([*map(Op, *(ops[c].tolist() for c in Op._fields))])
        return pd.DataFrame({"store": [key[0]] * len(ops), "seq": ops["seq"].array, "name": ops["name"].array, "status": [s for s, _ in got], "error": [e for _, e in got]})

    return updates.groupBy("store").cogroup(refs.groupBy("store")).applyInPandas(run, "store string, seq long, name string, status string, error string")

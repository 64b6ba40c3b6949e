"""Packs as DataFrames: indexes, reverse indexes, fan-out, Bloom filters, scanning, delta resolution and ingest."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from objloom.functions import codecs as C
from objloom.functions.objects import FORMATS, oid
from objloom.functions.schema import struct
from objloom.operators.graph import resolve_chains
from objloom.operators.lineage import Parts, cut

# -- indexes


def _ranked(rows: DataFrame, bucket: Column, order: str, name: str) -> DataFrame:
    """rows with their position in their pack by ``order``, whose order that of ``bucket`` follows.

    Rows of each bucket are counted, buckets before it summed up in a pack
    (few rows), and ranks within a bucket added.  So what meets in one task is
    a bucket's rows, not a pack's.
    """
    keyed = rows.withColumn("_bucket", bucket)
    counts = keyed.groupBy("pack", "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy("pack").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("pack", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(W.partitionBy("pack", "_bucket").orderBy(order)) - 1
    return keyed.join(bases, ["pack", "_bucket"]).withColumn(name, F.col("_base") + own).drop("_bucket", "_base")


def index(entries: DataFrame) -> DataFrame:
    """(pack, idx_pos, oid, crc32, offset): entries of each pack by id.  Ids are dealt by their first two bytes, of 65,536."""
    rows = entries.select("pack", "oid", "crc32", "offset")
    return _ranked(rows, F.substring("oid", 1, 2), "oid", "idx_pos").select("pack", "idx_pos", "oid", "crc32", "offset")


#: Bytes of a pack whose entries are ranked together.
SPAN = 1 << 20


def reverse_index(entries: DataFrame) -> DataFrame:
    """(pack, pack_pos, idx_pos): the index position of each entry in pack order, dealt by offset."""
    rows = _ranked(entries.select("pack", "oid", "offset"), F.substring("oid", 1, 2), "oid", "idx_pos")
    return _ranked(rows, F.floor(F.col("offset") / SPAN), "offset", "pack_pos").select("pack", "pack_pos", "idx_pos")


def fanout(entries: DataFrame) -> DataFrame:
    """(pack, bucket, total): how many ids begin with a byte up to bucket, for each of 256.  Counted before the running sum, so a pack's sum has 256 rows."""
    counts = entries.groupBy("pack", F.conv(F.hex(F.substring("oid", 1, 1)), 16, 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    grid = entries.select("pack").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(255))))
    full = grid.join(counts, ["pack", "bucket"], "left")
    return full.select("pack", "bucket", F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("pack").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)).alias("total"))


# -- Bloom filters


def bloom_buckets(n: Column) -> Column:
    """The next power of two of ceil(n / 48), at most 2**31."""
    need = F.greatest(F.ceil(n / C.PER_BUCKET), F.lit(1))
    return F.least(F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(need)).cast("int")), F.lit(1 << 31))


def bloom_bits(oid_: Column, lead: Column, probes: int = C.PROBES) -> Column:
    """array(struct(bucket, word, mask)) of an id's probes; lead is log2 of the number of buckets.

    Fields are cut from the first 128 bits of the id, as two numbers; bit 0 of
    a bucket is the first word's most significant bit.
    """
    bits = F.concat(*[F.lpad(F.conv(F.hex(F.substring(oid_, 1 + 4 * i, 4)), 16, 2), 32, "0") for i in range(4)])
    bucket = F.when(lead == 0, 0).otherwise(F.conv(F.substr(bits, F.lit(1), lead), 2, 10)).cast("long")
    fields = [F.conv(F.substr(bits, lead + 1 + 9 * i, F.lit(9)), 2, 10).cast("int") for i in range(probes)]
    return F.array(*[F.struct(bucket.alias("bucket"), F.floor(f / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (63 - f % 64).cast("int")).alias("mask")) for f in fields])


def bloom(entries: DataFrame, probes: int = C.PROBES) -> DataFrame:
    """(pack, buckets, bucket, word, mask) of each pack's filter: an OR aggregate, combined before its shuffle."""
    lead = entries.groupBy("pack").agg(bloom_buckets(F.count("*")).alias("buckets")).withColumn("lead", F.round(F.log2("buckets")).cast("int"))
    bits = entries.join(lead, "pack").select("pack", "buckets", F.explode(bloom_bits(F.col("oid"), F.col("lead"), probes)).alias("b"))
    return bits.groupBy("pack", "buckets", "b.bucket", "b.word").agg(F.bit_or("b.mask").alias("mask"))


def bloom_probe(ids: DataFrame, filters: DataFrame, probes: int = C.PROBES) -> DataFrame:
    """(pack, oid) of the packs whose filter may contain an id.

    An id's probes depend on a filter's size alone and all lie in one bucket,
    so there is one row for each id and each of the (at most 32) sizes there
    are, with the eight words that it needs, and one for each bucket that
    exists: an equi-join of these, never all pairs of ids and packs.
    """
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.coalesce(F.element_at(F.col("m"), i), F.lit(0).cast("long")))
    held = filters.groupBy("pack", "buckets", "bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("m"))  # 8 words at most
    held = held.select("pack", F.round(F.log2("buckets")).cast("int").alias("lead"), "bucket", words.alias("have"))
    leads = sorted(r.lead for r in filters.select(F.round(F.log2("buckets")).cast("int").alias("lead")).distinct().collect())  # powers of two up to 2**31
    if not leads:
        return ids.select(F.lit(None).cast(filters.schema["pack"].dataType).alias("pack"), "oid").limit(0)
    asked = ids.select("oid").distinct().withColumn("lead", F.explode(F.array(*map(F.lit, leads)))).withColumn("b", bloom_bits(F.col("oid"), F.col("lead"), probes))
    of = lambda i: F.aggregate("b", F.lit(0).cast("long"), lambda acc, x: F.when(x["word"] == i, acc.bitwiseOR(x["mask"])).otherwise(acc))
    asked = asked.select("oid", "lead", F.col("b")[0]["bucket"].alias("bucket"), F.array(*[of(i) for i in range(8)]).alias("need"))
    fits = F.forall(F.zip_with("need", "have", lambda n, h: n.bitwiseAND(h) == n), lambda x: x)
    return asked.join(held, ["lead", "bucket"]).where(fits).select("pack", "oid")


def find(ids: DataFrame, indexes: DataFrame, priority: DataFrame) -> DataFrame:
    """(oid, pack, offset) of the first pack that has each id; Spark's runtime filters do what a Bloom filter would."""
    hits = ids.join(indexes.select("pack", "oid", "offset"), "oid").join(priority, "pack")
    return hits.groupBy("oid").agg(F.min_by(F.struct("pack", "offset"), "priority").alias("h")).select("oid", "h.*")


# -- scanning

ENTRY = struct(
    "pack string, pack_pos long, offset long, header_len int, packed_len long, crc32 long, entry_type string, size long, base_offset long, base_oid binary, payload binary, error string"
)


def scan(files: DataFrame, fmt: str = "sha1", max_size: int = 0) -> DataFrame:
    """Entries of packs given as (path, content).  An entry's end is known only once it is inflated, so a pack is one task's work; a bad pack gives one row with its error."""

    schema = to_arrow_schema(ENTRY)

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = C.scan_pack(data, fmt, max_size)
                except C.CodecError as e:
                    rows = [{"error": e.code}]
                for a in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in ENTRY} | {"pack": path} for r in rows[a : a + 1000]], schema=schema)

    return files.select("path", "content").mapInArrow(run, ENTRY)


def applied(pairs: DataFrame, max_size: int = 0) -> DataFrame:
    """pairs(…, base, delta) with content and error of the delta applied; a result of over max_size bytes is ErrObjectTooLarge."""
    fields = [T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]
    schema = T.StructType([*pairs.schema.fields, *fields])

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            out: tuple[list, list] = ([], [])
            for base, delta in zip(b.column("base").to_pylist(), b.column("delta").to_pylist(), strict=True):
                try:
                    got = (C.apply_delta(base, delta, max_size), None)
                except C.CodecError as e:
                    got = (None, e.code)
                for x, v in zip(out, got, strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], names=schema.names)

    return pairs.mapInArrow(run, schema)


# -- headers and sizes without content

HEAD = struct("pack string, offset long, oid binary, entry_type string, size long, base_offset long, base_oid binary, error string")


def entry_heads(files: DataFrame, indexes: DataFrame, fmt: str = "sha1") -> DataFrame:
    """(pack, offset, oid, entry_type, size, base_offset, base_oid, error) of the entries that indexes(pack, oid, offset) name.

    Only headers are read, and of a delta the first bytes that tell its
    result's size; no content is inflated.
    """
    places = indexes.groupBy("pack").agg(F.collect_list(F.struct("offset", "oid")).alias("places"))  # a pack's own index
    schema = to_arrow_schema(HEAD)

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for pack, data, own in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                rows = []
                for at in own:
                    row = {"pack": pack, "offset": at["offset"], "oid": at["oid"]}
                    try:
                        e = C.parse_entry_header(data, at["offset"], fmt)
                        delta = e["type"] in ("ofs", "ref")
                        row |= {"entry_type": e["type"], "size": C.delta_sizes(C.inflate_head(data, e["end"], 20))[1] if delta else e["size"], "base_oid": e["base"]}
                        if e["distance"] is not None:
                            if not 0 < e["distance"] <= at["offset"]:
                                raise C.CodecError("ErrMalformedOfsDistance")
                            row["base_offset"] = at["offset"] - e["distance"]
                    except C.CodecError as e:
                        row["error"] = e.code
                    rows.append({f.name: row.get(f.name) for f in HEAD})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select(F.col("path").alias("pack"), "content").join(places, "pack").select("pack", "content", "places").mapInArrow(run, HEAD)


def sizes(heads: DataFrame) -> DataFrame:
    """(pack, oid, size, error): no chain is walked."""
    return heads.select("pack", "oid", "size", "error")


def headers(heads: DataFrame) -> DataFrame:
    """(pack, oid, otype, size, error): a delta's type is that at the end of its chain, found by pointer doubling."""
    node = F.concat_ws(":", "pack", "offset")
    by_id = heads.where("base_oid IS NOT NULL").select("pack", "offset", "base_oid").join(
        heads.groupBy("pack", F.col("oid").alias("base_oid")).agg(F.min("offset").alias("base_offset")), ["pack", "base_oid"]
    )
    edges = heads.where("base_offset IS NOT NULL").select("pack", "offset", "base_offset").unionByName(by_id.select("pack", "offset", "base_offset"))
    chains = resolve_chains(edges.select(node.alias("node"), F.concat_ws(":", "pack", "base_offset").alias("next")))
    whole = heads.where("NOT entry_type IN ('ofs', 'ref')").select(node.alias("terminal"), F.col("entry_type").alias("end_type"))
    ends = chains.join(whole, "terminal").select("node", "end_type")
    out = heads.withColumn("node", node).join(ends, "node", "left")
    otype = F.when(~F.col("entry_type").isin("ofs", "ref"), F.col("entry_type")).otherwise(F.col("end_type"))
    return out.select("pack", "oid", otype.alias("otype"), "size", F.coalesce("error", F.when(otype.isNull(), "ErrMissingBases")).alias("error"))


# -- packs on disk: what may be opened

def opened(files: DataFrame, indexes: DataFrame, fmt: str = "sha1") -> DataFrame:
    """(pack, objects, error) of every index: its pack must be there, whole, with the number of entries and the hash that the index has.

    files(pack, content) and indexes(pack, hash, objects), joined by the files'
    name without its ending.
    """
    schema = struct("pack string, hash string, objects long, error string")

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            rows = []
            for pack, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    n, trailer = C.pack_trailer(data, fmt)
                    rows.append({"pack": pack, "hash": trailer.hex(), "objects": n, "error": None})
                except C.CodecError as e:
                    rows.append({"pack": pack, "hash": None, "objects": None, "error": e.code})
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    have = files.select("pack", "content").mapInArrow(run, schema).select("pack", F.col("hash").alias("own_hash"), F.col("objects").alias("own"), F.col("error").alias("bad"))
    both = indexes.select("pack", "hash", "objects").join(have, "pack", "left")
    error = (
        F.when(F.col("own_hash").isNull() & F.col("bad").isNull(), "ErrPackNotFound").when(F.col("bad").isNotNull(), F.col("bad"))
        .when(F.col("own") != F.col("objects"), "ErrMalformedIndex: count").when(F.col("own_hash") != F.col("hash"), "ErrMalformedIndex: pack hash")
    )
    return both.select("pack", "objects", error.alias("error"))


def usable_filters(filters: DataFrame, indexes: DataFrame) -> DataFrame:
    """filters(…, pack, hash, error) that are whole and were built for the pack of their name; others are as if absent."""
    good = filters.where("error IS NULL").join(indexes.select("pack", "hash"), ["pack", "hash"], "left_semi")
    return good


def reconciled(known: DataFrame, listed: DataFrame) -> DataFrame:
    """(pack, state) of two sets of packs: kept, new or retired."""
    a, b = known.select("pack").distinct().withColumn("_a", F.lit(True)), listed.select("pack").distinct().withColumn("_b", F.lit(True))
    state = F.when(F.col("_a") & F.col("_b"), "kept").when(F.col("_b"), "new").otherwise("retired")
    return a.join(b, "pack", "full").select("pack", state.alias("state"))


def refreshed(known: DataFrame, listed: DataFrame) -> DataFrame:
    """(pack, state, error) after a refresh to listed(pack, error), all or nothing.

    A new pack that can't be opened leaves the known packs as they were: its
    row has its error, and no other new or retired ones are reported.
    """
    rows = reconciled(known, listed).join(listed.select("pack", "error"), "pack", "left").withColumn("error", F.when(F.col("state") == "new", F.col("error")))
    failed = rows.where("error IS NOT NULL").agg(F.count("*").alias("_failed"))
    out = rows.join(F.broadcast(failed), F.lit(True))  # one row
    left = F.col("_failed") == 0
    state = F.when(left, F.col("state")).when(F.col("state") == "retired", "kept").otherwise(F.col("state"))
    return out.where(left | (F.col("state") != "new") | F.col("error").isNotNull()).select("pack", F.when(F.col("error").isNull(), state).alias("state"), "error")


def chain_depths(entries: DataFrame) -> DataFrame:
    """(node, root, depth, error) of deltas by offset: pointer doubling, so a chain of 4096 takes 12 rounds."""
    nodes = F.concat_ws(":", "pack", "offset")
    edges = entries.where("base_offset IS NOT NULL").select(nodes.alias("node"), F.concat_ws(":", "pack", "base_offset").alias("next"))
    chains = resolve_chains(edges)
    return chains.select("node", F.col("terminal").alias("root"), F.col("hops").alias("depth"), F.when(F.col("cycle") | (F.col("hops") > C.MAX_DEPTH), "ErrMalformedPack").alias("error"))


def resolve(entries: DataFrame, fmt: str = "sha1", external: DataFrame | None = None, max_size: int = 0) -> DataFrame:
    """(pack, offset, otype, content, oid, depth) of every entry that can be reconstructed; see resolve_all."""
    return resolve_all(entries, fmt, external, max_size)[0]


def resolve_all(entries: DataFrame, fmt: str = "sha1", external: DataFrame | None = None, max_size: int = 0) -> tuple[DataFrame, DataFrame]:
    """What can be reconstructed, as (pack, offset, otype, content, oid, depth), and the deltas that failed, as (pack, offset, error).

    A frontier of resolved objects is joined to the deltas on it, by offset and
    by id (a base named by id may itself be a delta, whose id is known only
    once it is resolved), level by level.  A level's contents are written once
    and only read as the next level's bases; what is kept of the levels before
    are their keys.  external(oid, otype, content) are objects of a wider store.
    """
    entries = entries.where("error IS NULL")
    plain = entries.where(~F.col("entry_type").isin("ofs", "ref"))
    base = plain.select("pack", "offset", F.col("entry_type").alias("otype"), F.col("payload").alias("content"), F.lit(0).alias("depth"))
    by_offset = entries.where("entry_type = 'ofs'").select("pack", F.col("offset").alias("own"), F.col("base_offset").alias("offset"), F.col("payload").alias("delta"))
    by_id = entries.where("entry_type = 'ref'").select("pack", F.col("offset").alias("own"), F.col("base_oid").alias("oid"), F.col("payload").alias("delta"))
    front = cut(base.withColumn("oid", oid(F.col("otype"), F.col("content"), fmt)))
    own = ["pack", "offset", "otype", "content", "oid", "depth"]
    levels, keys, failed, depth = Parts(), Parts(), Parts(), 0
    levels.add(front.select(own))
    failed.add(entries.limit(0).select("pack", "offset", F.lit("").alias("error")))
    named = not by_id.isEmpty()  # only deltas by id can meet their base twice
    if named:
        keys.add(front.select("pack", "offset"))
    while True:
        depth += 1
        bases = front.select("pack", "offset", "oid", "otype", F.col("content").alias("base"))
        # a delta by offset has one base, so it comes once; one by id may meet equal bases at several levels
        pairs = by_offset.join(bases.where("offset >= 0"), ["pack", "offset"]).select("pack", "own", "otype", "base", "delta")
        if named:
            left = by_id.join(bases.dropDuplicates(["pack", "oid"]), ["pack", "oid"]).join(keys.all().withColumnRenamed("offset", "own"), ["pack", "own"], "left_anti")
            pairs = pairs.unionAll(left.select("pack", "own", "otype", "base", "delta"))
        made = applied(pairs, max_size).select("pack", F.col("own").alias("offset"), "otype", "content", F.lit(depth).alias("depth"), "error")
        made = cut(made.withColumn("oid", F.when(F.col("error").isNull(), oid(F.col("otype"), F.col("content"), fmt))))
        n = made.agg(F.count("*").alias("all"), F.count("error").alias("bad")).first()
        if depth <= C.MAX_DEPTH and n["all"]:
            front = made.where("error IS NULL").select(own)
            levels.add(front)
            if n["bad"]:
                failed.add(made.where("error IS NOT NULL").select("pack", "offset", "error"))
            if named:
                keys.add(made.select("pack", "offset"))
        elif external is not None and named:  # what the packs themselves can't give
            wanted = by_id.withColumnRenamed("own", "offset").join(keys.all(), ["pack", "offset"], "left_anti").select("pack", "oid").distinct()
            front = cut(wanted.join(external.select("oid", "otype", "content"), "oid").select("pack", F.lit(-1).cast("long").alias("offset"), "otype", "content", F.lit(0).alias("depth"), "oid"))
            external, depth = None, 0
        else:
            return levels.all(), failed.all()


def missing_bases(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """(pack, base_oid) that no resolved object of the pack has, each once, in the order of first reference (seq)."""
    wanted = entries.where("entry_type = 'ref'").groupBy("pack", "base_oid").agg(F.min("offset").alias("seq"))
    return wanted.join(resolved.select("pack", F.col("oid").alias("base_oid")), ["pack", "base_oid"], "left_anti")


def explain(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """A report row for each entry: what it is, its base, its recomputed id, and a delta's instructions; unresolved bases are noted, not fatal."""
    note = F.when(F.col("oid").isNull(), "unresolved base")
    out = entries.join(resolved.select("pack", "offset", "otype", "oid", "depth"), ["pack", "offset"], "left").withColumn("note", note)
    fields = [T.StructField("base_size", T.LongType()), T.StructField("result_size", T.LongType()), T.StructField("instructions", T.ArrayType(T.StringType()))]
    kept = [f for f in out.schema.fields if f.name != "payload"]
    schema = T.StructType([*kept, *fields])

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            made: list[list] = [[], [], []]
            for kind, payload in zip(b.column("entry_type").to_pylist(), b.column("payload").to_pylist(), strict=True):
                row = (None, None, None)
                if kind in ("ofs", "ref"):
                    try:
                        base, result, ops = C.delta_instructions(payload)
                        row = base, result, [f"copy {o} {n}" if op == "copy" else f"insert {n}" for op, o, n, _ in ops]
                    except C.CodecError as e:
                        row = (None, None, [e.code])
                for x, v in zip(made, row, strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *(pa.array(x, k) for x, k in zip(made, (pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True))], names=schema.names)

    return out.mapInArrow(run, schema)


def complete_thin(files: DataFrame, missing: DataFrame, external: DataFrame, fmt: str = "sha1") -> DataFrame:
    """(path, content, completed) of packs with the bases they lack appended, their count and trailer written anew.

    missing(pack, base_oid, seq) is that of missing_bases.  Bases come from
    external(oid, otype, content), in the order in which they are first named,
    and must have the hash they are asked by (ErrObjectNotFound stays for
    whoever resolves the pack again, as a base that isn't there is left out).
    """
    got = missing.join(external.select(F.col("oid").alias("base_oid"), "otype", "content"), "base_oid").where(oid(F.col("otype"), F.col("content"), fmt) == F.col("base_oid"))
    bases = got.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("seq", "base_oid", "otype", "content"))).alias("bases"))
    rows = files.select(F.col("path").alias("pack"), F.col("content").alias("data")).join(bases, "pack")
    schema = struct("path string, content binary, completed string")

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            out = []
            for pack, data, own in zip(b.column("pack").to_pylist(), b.column("data").to_pylist(), b.column("bases").to_pylist(), strict=True):
                whole = C.complete_pack(data, [(x["otype"], x["content"]) for x in own], fmt)
                out.append({"path": whole[-C.SIZES[fmt] :].hex(), "content": whole, "completed": pack})
            yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(schema))

    return rows.mapInArrow(run, schema)


#: Tables that an ingest publishes beside the manifest.
TABLES = ("packs", "objects", "index", "reverse", "bloom")


def ingest(files: DataFrame, path: str, fmt: str = "sha1", max_size: int = 0, external: DataFrame | None = None) -> DataFrame:
    """Scan, resolve and publish packs under ``path``: tables packs, objects, index, reverse, bloom, and last the manifest.

    A pack that the manifest has is left alone, so a repeated run changes
    nothing.  A run writes its rows under its own id, and the manifest names
    the run of each pack; ``published`` reads by it, so what an interrupted run
    has left is never read, and its repetition isn't read twice.  Thin packs
    are completed from ``external`` (whole packs are published, under their new
    hash) or refused with ErrMissingBases; deltas that fail, or whose results
    are over max_size, refuse their pack with their own error.  Empty packs
    publish nothing.
    """
    spark = files.sparkSession
    n = FORMATS[fmt]
    named = files.select(F.lower(F.hex(F.substring("content", -n, n))).alias("path"), "content").dropDuplicates(["path"])
    known = manifest(spark, path)
    named = named.join(known.select(F.coalesce("received", "pack").alias("path")), "path", "left_anti")
    entries = cut(scan(named, fmt, max_size))
    resolved, failed = resolve_all(entries, fmt, None, max_size)
    received = entries.select("pack").distinct().withColumn("received", F.col("pack"))
    if external is not None:
        whole = cut(complete_thin(named, missing_bases(entries.where("error IS NULL"), resolved), external, fmt))
        if not whole.isEmpty():
            thin = whole.select(F.col("completed").alias("pack"))
            more = cut(scan(whole.select("path", "content"), fmt, max_size))
            ready, worse = resolve_all(more, fmt, None, max_size)
            apart = lambda df, other: df.join(thin, "pack", "left_anti").unionByName(other)
            received = apart(received, whole.select(F.col("path").alias("pack"), F.col("completed").alias("received")))
            entries, resolved, failed = cut(apart(entries, more)), apart(resolved, ready), apart(failed, worse)
            named = apart(named.withColumnRenamed("path", "pack"), whole.select(F.col("path").alias("pack"), "content")).withColumnRenamed("pack", "path")
    own = entries.where("error IS NOT NULL").select("pack", "error").unionByName(failed.select("pack", "error"))
    lost = entries.where("error IS NULL").join(resolved.select("pack", "offset"), ["pack", "offset"], "left_anti").select("pack", F.lit("ErrMissingBases").alias("error"))
    # a delta's own error comes before what is missing because of it
    bad = own.withColumn("k", F.lit(0)).unionByName(lost.withColumn("k", F.lit(1))).groupBy("pack").agg(F.min(F.struct("k", "error"))["error"].alias("error"))
    good = resolved.join(bad.select("pack"), "pack", "left_anti")
    table = cut(entries.select("pack", "offset", "crc32", "entry_type", "size").join(good, ["pack", "offset"]))
    run = uuid.uuid4().hex
    made = {"packs": named.join(table.select(F.col("pack").alias("path")).distinct(), "path", "left_semi").withColumnRenamed("path", "pack"), "objects": table, "index": index(table), "reverse": reverse_index(table), "bloom": bloom(table)}
    for name in TABLES:
        made[name].withColumn("run", F.lit(run)).write.mode("append").parquet(f"{path}/{name}")
    done = table.groupBy("pack").agg(F.count("*").alias("objects"), F.lit(fmt).alias("object_format")).join(received, "pack", "left").withColumn("run", F.lit(run))
    done.select("pack", "objects", "object_format", "received", "run").write.mode("append").parquet(f"{path}/manifest")
    return done.select("pack", "objects", F.lit(None).cast("string").alias("error")).unionByName(bad.select("pack", F.lit(0).cast("long").alias("objects"), "error"))


def manifest(spark, path: str) -> DataFrame:
    """(pack, objects, object_format, received, run): the first run that published each pack; received is its hash before completion."""
    schema = "pack string, objects long, object_format string, received string, run string"
    try:
        rows = spark.read.schema(schema).parquet(f"{path}/manifest")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return rows.groupBy("pack").agg(F.min_by(F.struct("objects", "object_format", "received", "run"), "run").alias("m")).select("pack", "m.*")


def published(spark, path: str, name: str) -> DataFrame:
    """A table of TABLES as the manifest has it."""
    return spark.read.parquet(f"{path}/{name}").join(manifest(spark, path).select("pack", "run"), ["pack", "run"], "left_semi").drop("run")

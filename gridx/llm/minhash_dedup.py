"""Near-duplicate documents: shingle sets linked at a Jaccard similarity, found by one-permutation hashing.

1. Each text becomes its set of distinct word shingles (64-bit hashes). Documents with equal sets form a class and
   are represented by their smallest doc_id from here on, so thousands of copies cost one row each. A class whose
   smallest doc_id has other sets too is a vertex of its own until links are confirmed, so all sets are searched.
2. One permutation: a shingle's hash names a bin and a value; a bin keeps its least value. Empty bins borrow from
   other bins by a second hash of (bin, attempt) until a filled one is hit (optimal densification).
3. Bands of bins are hashed to buckets. Inside a bucket candidate edges form a star, from its most central member
   (the one with most company over all its buckets) to the others, so candidates grow with the rows, not with
   their square. Every edge is confirmed on full sets.
4. A star edge that fails says nothing about the leaves among themselves. The leaves of such a star are compared with
   one another, those that the centre is not linked with and all others: a bucket of at most BLOCK leaves in one task.
   Larger buckets are taken together by groups; in a group the members outside its most frequent component are
   compared with all its members, block by block, which is linear in the group as long as those outside are few. So no
   link between texts that share a bucket depends on a centre.
5. Links make components; a document's component is the smallest doc_id it reaches.

With 34 bands of 6 bins a pair of similarity 0.85 shares no bucket with probability 3e-7.

Defined results: a null text or one without words has an empty set and is linked with nothing (it is its own
component); rows with a null doc_id are left out of linking and get a null component; repeated rows of a doc_id
share one component; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridx.llm import textvec as tv
from gridx.llm.common import FEW, HOT, broadcast_within, cut, looked_up, release, texts
from gridx.llm.components import components

U = np.uint64
BANDS, ROWS = 34, 6
WIDTH, PERCENT = 5, 85
_BITS = U(10)
_BELOW = U((1 << 54) - 1)
#: Members that are compared with one another in one task.
BLOCK = 256
SALT = HOT
CLASS = ["n_shingles", "s1", "s2"]


def sets_of(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle) pairs, distinct and sorted, and the number of pairs of each document. At most 1,024 documents."""
    doc, h = tv.shingles(data, off, width)
    keys = np.sort((doc.astype(U) << U(54)) | (h >> _BITS))
    if len(keys):
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    doc = (keys >> U(54)).astype(np.int64)
    return doc, keys & _BELOW, np.bincount(doc, minlength=len(off) - 1)


def sketch(doc: np.ndarray, values: np.ndarray, n_docs: int, bins: int) -> np.ndarray:
    """n_docs x bins: least value of each bin, empty bins filled by optimal densification; documents without values get 0."""
    out = np.zeros((n_docs, bins), U)
    filled = np.zeros((n_docs, bins), bool)
    where = doc * bins + (((values >> U(22)) * U(bins)) >> U(32)).astype(np.int64)
    head = np.concatenate(([True], where[1:] != where[:-1])) if len(where) else np.zeros(0, bool)
    out.reshape(-1)[where[head]] = values[head]
    filled.reshape(-1)[where[head]] = True
    d, b = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 1
    while len(d):
        other = ((tv.mix(b.astype(U) * U(0xD1342543DE82EF95) + U(attempt)) >> U(32)) * U(bins) >> U(32)).astype(np.int64)
        hit = filled[d, other]
        out[d[hit], b[hit]] = out[d[hit], other[hit]]
        d, b = d[~hit], b[~hit]
        attempt += 1
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key for each document and band; the band's number is part of it."""
    parts = sketches.reshape(len(sketches), bands, rows)
    key = np.broadcast_to(tv.mix(np.arange(1, bands + 1, dtype=U)), parts.shape[:2]).copy()
    for r in range(rows):
        key = tv.mix(key * U(0x9FB21C651E98DF25) + parts[:, :, r])
    return key


def class_sums(values: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each document's set; with its size they name its class."""
    sums = []
    for odd in (U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)):
        total = np.concatenate((np.zeros(1, U), np.cumsum(tv.mix(values * odd + U(7)))))
        at = np.concatenate(([0], np.cumsum(n)))
        sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return sums


def _sketches(width: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tv.buffers(batch.column("text"))
            for i, j in tv.chunks(off):
                doc, values, n = sets_of(data[off[i] : off[j]], off[i : j + 1] - off[i], width)
                sums = class_sums(values, n)
                keys = band_keys(sketch(doc, values, j - i, bands * rows), bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), lists], schema=schema)

    return run


def _sets(width: int, classed: bool = False):
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary()), *[(c, pa.int64()) for c in CLASS if classed]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tv.buffers(batch.column("text"))
            for i, j in tv.chunks(off):
                _, values, n = sets_of(data[off[i] : off[j]], off[i : j + 1] - off[i], width)
                at = np.concatenate(([0], np.cumsum(n))) * 8
                blob = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
                named = [pa.array(n.astype(np.int64)), *map(pa.array, class_sums(values, n))] if classed else []
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), blob, *named], schema=schema)

    return run


def _confirm(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(len(batch), bool)
            for r, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.sort(np.concatenate((x, y)))
                common = int((both[1:] == both[:-1]).sum())
                linked[r] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], schema=schema)

    return run


def _within_block(percent: int, two_sides: bool, columns: int = 1 << 12):
    """Exact links of the members of side 0 of a block with all its members, or with those of side 1.

    Members of one `tie` are known to be linked. Only links that join what is not yet linked are returned.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids, side, tie = (table[c].to_numpy() for c in ("doc_id", "side", "tie"))
        sets = [np.frombuffer(x.as_buffer(), U) for x in table["shingles"].combine_chunks()] if len(table) else []
        size = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), size)
        _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        frequent = df > 1  # a shingle of one member is in no intersection
        new = np.cumsum(frequent) - 1
        keep = frequent[col]
        row, col = row[keep], new[col[keep]]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1) if two_sides else np.arange(len(sets))
        common = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for c in range(0, int(frequent.sum()), columns):
            s, e = np.searchsorted(col, (c, c + columns))
            m = np.zeros((len(sets), columns), np.float32)
            m[row[s:e], col[s:e] - c] = 1
            common += m[left] @ m[right].T
        common = np.rint(common).astype(np.int64)
        union = size[left][:, None] + size[right][None, :] - common
        x, y = np.nonzero((100 * common >= percent * union) & (tie[left][:, None] != tie[right][None, :]))
        x, y = left[x], right[y]
        names, parent = np.unique(tie, return_inverse=True)
        parent, top_of = parent.tolist(), list(range(len(names)))

        def top(v: int) -> int:
            while top_of[v] != v:
                top_of[v] = top_of[top_of[v]]
                v = top_of[v]
            return v

        out = []
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            p1, q1 = top(parent[p]), top(parent[q])
            if p1 != q1:
                top_of[max(p1, q1)] = min(p1, q1)
                out.append((ids[p], ids[q]))
        out = np.array(out, np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], schema=schema)

    return run


def _sets_for(rows: DataFrame, wanted: DataFrame, width: int, own: DataFrame, n_own: int) -> DataFrame:
    """(doc_id, shingles) of the wanted vertices, given in place of doc_id; they are broadcast only if their count is small.

    own has the vertices that are not the id of their rows: v, rep and class.
    """
    n = wanted.count()
    found = rows.join(broadcast_within(wanted, n), "doc_id", "left_semi").dropDuplicates(["doc_id"]) if n else rows.limit(0)
    sets = found.mapInArrow(_sets(width), "doc_id long, shingles binary")
    if not n_own:
        return sets
    searched = own.join(wanted.select(F.col("doc_id").alias("v")), "v", "left_semi")
    several = rows.join(broadcast_within(searched.select(F.col("rep").alias("doc_id")).distinct(), n_own), "doc_id", "left_semi")
    classed = several.mapInArrow(_sets(width, True), "doc_id long, shingles binary, n_shingles long, s1 long, s2 long")
    vertices = searched.select("v", F.col("rep").alias("doc_id"), *CLASS)
    more = classed.join(broadcast_within(vertices, n_own), ["doc_id", *CLASS]).dropDuplicates(["v"])
    return sets.join(broadcast_within(own.select(F.col("rep").alias("doc_id")).distinct(), n_own), "doc_id", "left_anti").unionByName(more.select(F.col("v").alias("doc_id"), "shingles"))


def _stars(shared: DataFrame) -> DataFrame:
    """(key, a, b): for each bucket of (key, doc_id, n members) its centre, the member with most company over all its
    buckets, and each other member."""
    company = shared.groupBy("doc_id").agg(F.sum("n").alias("company"))
    ranked = shared.join(company, "doc_id")
    centre = ranked.groupBy("key").agg(F.max(F.struct("company", -F.col("doc_id"))).alias("top")).select("key", (-F.col("top.col2")).alias("a"))
    return shared.join(centre, "key").where("doc_id != a").select("key", "a", F.col("doc_id").alias("b"))


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) for the edges, on full sets. The set of an `a` with very many edges is dealt in salted copies;
    fewer than FEW have that many."""
    edges = cut(edges)
    hub = F.col("degree") > max(SALT, edges.count() / FEW)
    degree = edges.groupBy("a").agg(F.count("*").alias("degree")).select("a", F.when(hub, F.ceil(F.col("degree") / SALT)).otherwise(1).cast("int").alias("copies"))
    salted = edges.join(F.broadcast(degree.where("copies > 1")), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1))).cast("int"))
    centres = sets.join(degree, sets["doc_id"] == degree["a"]).select("a", F.col("shingles").alias("x"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    leaves = salted.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "salt", "y")
    return cut(leaves.join(centres, ["a", "salt"]).select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long, linked boolean"))


def _among_leaves(star: DataFrame, tested: DataFrame, linked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """linked and the links among the leaves of stars in which an edge failed."""
    flagged = cut(star.join(broadcast_within(tested, tested.count()), ["a", "b"]))
    keys = cut(flagged.where("not linked").select("key").distinct())
    tie = F.when(F.col("linked"), F.col("a")).otherwise(F.col("b"))
    leaves = cut(looked_up(flagged, keys, "key").select("key", F.col("b").alias("doc_id"), tie.alias("tie"), F.col("linked").cast("int").alias("side")))
    # buckets with the same members are compared once
    members = leaves.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id", "tie").cast("decimal(38,0)")).alias("sum")).where("n > 1")
    open_keys = cut(members.groupBy("n", "sum").agg(F.min("key").alias("key")).select("key", "n"))
    leaves = cut(looked_up(leaves, open_keys, "key"))
    small = leaves.where(F.col("n") <= BLOCK).join(sets, "doc_id").select("key", "side", "tie", "doc_id", "shingles")
    linked = cut(linked.unionByName(small.groupBy("key").applyInArrow(_within_block(percent, False), "a long, b long")))
    large = leaves.where(F.col("n") > BLOCK).select("key", "doc_id")
    if not large.limit(1).count():
        return linked
    # large buckets, whose members mostly recur in one another, are taken together by groups of star edges; all that
    # is not of a group's most frequent label is compared with all of the group
    group = components(looked_up(star, cut(large.select("key").distinct()), "key").select("a", "b").distinct())
    group = group.select(F.col("v").alias("doc_id"), F.col("label").alias("grp"))
    found = cut(large.select("doc_id").distinct().join(group, "doc_id"))
    labels = components(linked)
    named = cut(found.join(labels, found["doc_id"] == labels["v"], "left").select("grp", "doc_id", F.coalesce("label", "doc_id").alias("label")))
    per = named.groupBy("grp", "label").agg(F.count("*").alias("n"))
    most = per.groupBy("grp").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    sized = most.select("grp", F.col("top.label").alias("main"), blocks_of(F.col("all") - F.col("top.n")).alias("few"), blocks_of(F.col("all")).alias("many")).where("few > 0")
    marked = cut(looked_up(named, cut(sized), "grp"))
    block = lambda of, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(of)).cast("int")
    apart = marked.where("label != main").select("grp", "doc_id", block("few", 11).alias("i"), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("j"), F.lit(0).alias("side"), F.col("label").alias("tie"))
    every = marked.select("grp", "doc_id", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"), block("many", 12).alias("j"), F.lit(1).alias("side"), F.col("label").alias("tie"))
    filled = apart.unionByName(every).join(sets, "doc_id").select("grp", "i", "j", "side", "tie", "doc_id", "shingles")
    return linked.unionByName(cut(filled.groupBy("grp", "i", "j").applyInArrow(_within_block(percent, True), "a long, b long")))


def blocks_of(n):
    """Blocks of BLOCK members for so many."""
    return F.ceil(n / BLOCK).cast("int")


def links(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id and class), (classes: class, rep, n rows), (edges between representatives: a, b), cut from their lineage."""
    table = texts(docs)
    found = cut(table.mapInArrow(_sketches(width, bands, rows), "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>"))
    full = found.where("doc_id is not null and n_shingles > 0")
    # ids that repeat with different sets; a class that such an id represents is a vertex of its own
    spans = full.groupBy("doc_id").agg(F.min(F.struct(*CLASS)).alias("least"), F.max(F.struct(*CLASS)).alias("most"))
    mixed = cut(spans.where("least != most").select("doc_id"))
    n_mixed = mixed.count()
    classes = full.groupBy(*CLASS).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).withColumn("v", F.col("rep"))
    if n_mixed:
        several = broadcast_within(mixed.select(F.col("doc_id").alias("rep"), F.lit(True).alias("several")), n_mixed)
        classes = classes.join(several, "rep", "left").withColumn("v", F.when(F.col("several"), F.xxhash64("rep", *CLASS)).otherwise(F.col("rep"))).drop("several")
    classes = cut(classes)
    own = classes.where("v != rep").select("v", "rep", *CLASS)
    n_own = own.count() if n_mixed else 0
    vertices = classes.select(F.col("rep").alias("doc_id"), "v", *CLASS)
    if n_mixed:
        members = full.join(vertices, ["doc_id", *CLASS]).dropDuplicates(["v"])
    else:
        members = full.join(vertices.select("doc_id", "v"), "doc_id").dropDuplicates(["doc_id"])
    members = members.select(F.col("v").alias("doc_id"), F.explode("keys").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(members.join(sizes, "key").select("key", "doc_id", "n"))
    sets = cut(_sets_for(table, shared.select("doc_id").distinct(), width, own, n_own))
    star = cut(_stars(shared))
    release(docs.sparkSession)
    tested = _confirmed(star.select("a", "b").distinct(), sets, percent)
    linked = tested.where("linked").select("a", "b")
    if tested.where("not linked").limit(1).count():
        linked = _among_leaves(star, tested, linked, sets, percent)
        release(docs.sparkSession)
    if n_mixed:  # back to ids, and an id links its sets' classes
        for end in ("a", "b"):
            rep = broadcast_within(own.select(F.col("v").alias(end), "rep"), n_own)
            linked = linked.join(rep, end, "left").withColumn(end, F.coalesce("rep", end)).select("a", "b")
        same = full.join(broadcast_within(mixed, n_mixed), "doc_id", "left_semi").select("doc_id", *CLASS).distinct()
        linked = linked.unionByName(same.join(classes, list(CLASS)).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    linked = cut(linked)
    release(docs.sparkSession)
    return found.select("doc_id", *CLASS), classes, linked


def _of_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with their class's component; neither a large class nor the rows without words gather in one task."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    large = classes.where(F.col("n") > max(1, total / FEW))
    marked = rows.join(F.broadcast(large.select(*CLASS, F.col("component").alias("found"))), CLASS, "left")
    settled = F.col("found").isNotNull() | (F.col("n_shingles") == 0)
    spread = [F.when(settled, -1).otherwise(F.col("n_shingles")).alias("k0"), F.when(settled, F.xxhash64("doc_id")).otherwise(F.col("s1")).alias("k1"), F.col("s2").alias("k2")]
    small = classes.where(F.col("n") <= max(1, total / FEW)).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(CLASS)], "component")
    joined = marked.select("doc_id", "n_shingles", "found", *spread).join(small, ["k0", "k1", "k2"], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("found", "component").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable)."""
    found, classes, linked = links(docs, percent, width, bands, rows)
    labels = components(linked)
    named = cut(classes.join(labels, classes["rep"] == labels["v"], "left").select(*CLASS, "n", F.coalesce("label", "rep").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return _of_class(found, named).select("doc_id", "n_shingles", component.alias("component_id"))


#: The rows of op2 in SQL: sets, links and reachability by joins, which is for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS p FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, e.b FROM reach JOIN both_ways e ON reach.r = e.a
), least AS (
  SELECT v, min(r) AS component_id FROM reach GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN least ON v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

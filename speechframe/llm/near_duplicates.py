"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with one set of word shingles form a class, and only classes are compared. Classes that agree
in a band of MinHash values are compared by short sketches of those values, a few at a time: pairs
whose posterior probability of reaching the threshold falls below the tolerance are dropped, and what
is left is handed on as a forest, a link a class at most. A band's classes meet its least one first;
only those that it rules out meet all others, so a group of near copies costs as many comparisons as
it has members. The connected components of the forest hold every candidate pair. A component is cut
into blocks of bounded size, and each pair of blocks is one task's work: whole MinHash values are
compared in the same way, and the pairs that stay are verified on their shingle sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechframe.llm.common import joined_on, row_key, small_batches, without_rows, written
from speechframe.llm.graph import components
from speechframe.llm.shingles import MinHash, _ranges, shingle_sets, text_chunks

#: Bands of rows: a pair at the threshold of 0.8 shares no band with probability (1 - 0.8^4)^32 < 5e-8.
BANDS, ROWS = 32, 4
#: MinHash values compared between two prunings, and values of a sketch: a byte of every second one.
STEP, SKETCH = 16, 64
#: Rows of classes in bands that one task compares at a time, and pairs of them.
SLOT_ROWS, SLOT_PAIRS = 4_000, 1 << 18
#: Classes and shingles of a block; a pair of blocks is compared in one task.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1 << 20
#: Rows of candidate classes up to which they are broadcast (some 80 bytes a row); beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Columns of the incidence matrices that are multiplied at a time.
COLUMNS = 4096


def least_matches(threshold: float, tolerance: float, hashes: int, step: int) -> list[int]:
    """For each step: the fewest equal MinHash values with which a pair stays.

    With a uniform prior, m of n equal values leave similarity s at or above the threshold with
    probability P(Bin(n + 1, threshold) <= m).
    """
    out = []
    for n in range(step, hashes + 1, step):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def sketches(docs: DataFrame, size: int = 5) -> DataFrame:
    """Per document row: doc_id, row (row_key()), class (digest of its shingle set; null without words), n_shingles, signature, sketch."""
    docs = docs.select("doc_id", "text", row_key().alias("row"))

    def run(batches):
        minhash = MinHash(BANDS * ROWS)
        for batch in batches:
            ids = batch.column(0)
            for first, texts in text_chunks(batch.column(1)):
                sets = shingle_sets(texts, size)
                full = [i for i, s in enumerate(sets) if len(s)]
                rows = minhash.signatures(sets[i] for i in full)
                signature, sketch = [None] * len(sets), [None] * len(sets)
                for i, row in zip(full, rows, strict=True):
                    signature[i], sketch[i] = row.tobytes(), row.astype("<u4").view(np.uint8)[:: 4 * BANDS * ROWS // SKETCH].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(texts)),
                        batch.column(2).slice(first, len(texts)),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array(signature, pa.binary()),
                        pa.array(sketch, pa.binary()),
                    ],
                    names=["doc_id", "row", "class", "n_shingles", "signature", "sketch"],
                )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, class binary, n_shingles int, signature binary, sketch binary")


def _alike(sketches: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs of sketches are not ruled out."""
    alike = np.zeros(len(i), dtype=bool)
    for a in range(0, len(i), SLOT_PAIRS):
        at = np.arange(a, min(a + SLOT_PAIRS, len(i)))
        m = np.zeros(len(at), dtype=np.int16)
        for step, fewest in enumerate(least):
            part = slice(step * STEP, (step + 1) * STEP)
            m += (sketches[i[at], part] == sketches[j[at], part]).sum(axis=1, dtype=np.int16)
            at, m = at[m >= fewest], m[m >= fewest]
        alike[at] = True
    return alike


def _forest(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.Table:
    """u, v: edges that connect what the pairs of rows connect, a class being one node wherever it stands."""
    classes, node = np.unique(names, return_inverse=True)
    roots = _roots(len(classes), node[i], node[j])
    apart = np.flatnonzero(roots != np.arange(len(roots)))
    return pa.table({"u": pa.array(classes[apart].tolist(), pa.binary()), "v": pa.array(classes[roots[apart]].tolist(), pa.binary())})


def _columns(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Classes and sketches of a table's rows."""
    names = np.array(group.column("class").to_pylist(), dtype=object)
    return names, np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(names), SKETCH)


def _bands_compared(least: list[int]):
    def run(group: pa.Table) -> pa.Table:
        """The forest of a table of whole bands (key, class, sketch)."""
        names, sketches = _columns(group)
        key = group.column("key").to_numpy()
        order = np.array(sorted(range(len(key)), key=lambda i: (key[i], names[i])), dtype=np.int64)
        names, sketches, key = names[order], sketches[order], key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(begin, len(key)))
        first = np.repeat(begin, size)
        near = _alike(sketches, np.arange(len(key)), first, least)
        rest = np.flatnonzero(~near)
        each = np.repeat(size, size)[rest]
        left, right = [np.flatnonzero(near)], [first[near]]
        # a part of the pairs at a time, of which a tree for each connected piece is kept
        for part in np.split(np.arange(len(rest)), np.flatnonzero(np.diff(np.cumsum(each) // (4 * SLOT_PAIRS))) + 1):
            i, j = np.repeat(rest[part], each[part]), _ranges(first[rest[part]], each[part])
            useful = near[j] & (j != first[i]) | (j > i)
            i, j = i[useful], j[useful]
            stay = _alike(sketches, i, j, least)
            root = _roots(len(key), i[stay], j[stay])
            left.append(np.flatnonzero(root != np.arange(len(root))))
            right.append(root[left[-1]])
        return _forest(names, np.concatenate(left), np.concatenate(right))

    return run


def _blocks_compared(least: list[int]):
    def run(group: pa.Table) -> pa.Table:
        """The forest of one pair of blocks of a large band: what its least class rules out, against each other or the rest."""
        names, sketches = _columns(group)
        own, near = group.column("own").to_numpy(), group.column("near").to_numpy(zero_copy_only=False)
        low, among = group.column("low")[0].as_py(), group.column("among")[0].as_py()
        left = np.flatnonzero(~near & (own == low)) if among else np.flatnonzero(~near)
        right = np.flatnonzero(own == group.column("high")[0].as_py()) if among else np.flatnonzero(near)
        i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        stay = _alike(sketches, i, j, least)
        return _forest(names, i[stay], j[stay])

    return run


def _large_bands(rows: DataFrame, least: list[int]) -> DataFrame:
    """u, v: the forest of bands that are too large for one task."""
    firsts = rows.groupBy("key").agg(F.min(F.struct("class", "sketch")).alias("least"))

    def mark(batches):
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sides = np.frombuffer(b"".join(columns["sketch"].to_pylist() + columns["first"].to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
            at = np.arange(batch.num_rows)
            near = _alike(sides, at, at + batch.num_rows, least)
            yield pa.RecordBatch.from_arrays([columns["key"], columns["class"], columns["sketch"], columns["least"], pa.array(near)], names=["key", "class", "sketch", "least", "near"])

    # at most one row for each BLOCK_CLASSES of rows
    few = firsts.count() <= BROADCAST_ROWS
    met = rows.join(F.broadcast(firsts) if few else firsts, "key").select("key", "class", "sketch", F.col("least.class").alias("least"), F.col("least.sketch").alias("first"))
    marked = written(met.mapInArrow(mark, "key long, class binary, sketch binary, least binary, near boolean"), "marked")
    star = marked.where("near AND class <> least").select(F.col("class").alias("u"), F.col("least").alias("v"))
    left = marked.groupBy("key").agg(F.count_if(~F.col("near")).alias("rest"), F.count_if("near").alias("kin")).where("rest > 0")
    parts = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK_CLASSES), F.lit(1)).cast("int")
    left = left.select("key", parts("rest").alias("rests"), parts("kin").alias("kins"))
    grid = marked.join(F.broadcast(left) if few else left, "key").withColumn("own", F.pmod(F.xxhash64("class"), F.when(F.col("near"), F.col("kins")).otherwise(F.col("rests"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda among, low, high: F.struct(among.alias("among"), low.alias("low"), high.alias("high"))
    with_rest = F.transform(upto("rests"), lambda k: cell(F.lit(True), F.least("own", k), F.greatest("own", k)))
    with_kin = F.transform(upto("kins"), lambda k: cell(F.lit(False), F.col("own"), k))
    of_kin = F.transform(upto("rests"), lambda k: cell(F.lit(False), k, F.col("own")))
    cells = grid.select("key", "class", "sketch", "near", "own", F.explode(F.when(F.col("near"), of_kin).otherwise(F.concat(with_rest, with_kin))).alias("cell"))
    return star.union(cells.select("key", "class", "sketch", "near", "own", "cell.*").groupBy("key", "among", "low", "high").applyInArrow(_blocks_compared(least), "u binary, v binary"))


def _candidates(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """class, root: the classes that may be linked to another, by component."""
    width = 4 * ROWS
    least = least_matches(threshold, tolerance, SKETCH, STEP)
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("signature", b * width + 1, width)) for b in range(BANDS)])
    banded = classes.select("class", F.explode(keys).alias("key"))
    shared = written(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = joined_on(banded, shared, "key", BANDS * classes.count())
    rows = written(met.join(classes.select("class", "sketch"), "class").select("key", "n", "class", "sketch"), "bands")
    large = F.col("n") > BLOCK_CLASSES
    slots = math.ceil(rows.count() / SLOT_ROWS) or 1
    edges = rows.where(~large).select("key", "class", "sketch", F.pmod("key", F.lit(slots)).alias("slot")).groupBy("slot").applyInArrow(_bands_compared(least), "u binary, v binary")
    if not (many := rows.where(large)).isEmpty():
        edges = edges.union(_large_bands(many, least))
    return components(edges).select(F.col("node").alias("class"), "root")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted (class, doc_id, ...) with each class's shingles and signature, from the text of its first document."""
    wanted = wanted.withColumnRenamed("doc_id", "__doc")
    fields = wanted.drop("__doc").schema
    few = wanted.count() <= BROADCAST_ROWS
    joined = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("__doc")).drop("doc_id", "__doc")
    at = joined.columns.index("class")

    def run(batches):
        minhash = MinHash(BANDS * ROWS)
        for batch in batches:
            for first, texts in text_chunks(batch.column(0)):
                part = batch.slice(first, len(texts))
                sets = shingle_sets(texts, size)
                own = part.column(at).to_pylist()
                # another row may have the same doc_id and a different text
                keep = [i for i, (s, c) in enumerate(zip(sets, own, strict=True)) if len(s) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == c]
                sets = [sets[i] for i in keep]
                columns = [*part.take(pa.array(keep, pa.int64())).columns[1:], pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([r.tobytes() for r in minhash.signatures(sets)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[1:], "shingles", "signature"])

    return joined.mapInArrow(run, fields.add("shingles", "binary").add("signature", "binary")).dropDuplicates(["class"])


def _surviving(left: np.ndarray, right: np.ndarray, mask: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows under the mask that the MinHash values do not rule out."""
    matches = np.zeros(mask.shape, dtype=np.int16)
    for k in range(STEP):
        matches += left[:, k, None] == right[None, :, k]
    i, j = np.nonzero(mask & (matches >= least[0]))
    m = matches[i, j]
    for step, fewest in enumerate(least[1:], 1):
        at = slice(step * STEP, (step + 1) * STEP)
        m = m + np.concatenate([(left[i[a : a + 65536], at] == right[j[a : a + 65536], at]).sum(axis=1, dtype=np.int16) for a in range(0, max(len(i), 1), 65536)])
        stay = m >= fewest
        i, j, m = i[stay], j[stay], m[stay]
    return i, j


def _shared(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of shingles that left[i] and right[j] have in common, for each pair: products of incidence matrices
    over the shingles that both sides hold."""
    rows, at_i = np.unique(i, return_inverse=True)
    cols, at_j = np.unique(j, return_inverse=True)
    flat = [np.concatenate([side[k] for k in which]) for side, which in ((left, rows), (right, cols))]
    owner = [np.repeat(np.arange(len(which)), [len(side[k]) for k in which]) for side, which in ((left, rows), (right, cols))]
    both = np.intersect1d(flat[0], flat[1])
    place = [np.searchsorted(both, f) for f in flat]
    held = [(p < len(both)) & (both[np.minimum(p, len(both) - 1)] == f) if len(both) else np.zeros(len(f), bool) for p, f in zip(place, flat, strict=True)]
    place, owner = [p[h] for p, h in zip(place, held, strict=True)], [o[h] for o, h in zip(owner, held, strict=True)]
    order = [np.argsort(p, kind="stable") for p in place]
    place, owner = [p[o] for p, o in zip(place, order, strict=True)], [w[o] for w, o in zip(owner, order, strict=True)]
    total = np.zeros((len(rows), len(cols)), dtype=np.float32)
    for first in range(0, len(both), COLUMNS):
        sides = []
        for p, w, n in zip(place, owner, (len(rows), len(cols)), strict=True):
            a, b = np.searchsorted(p, (first, first + COLUMNS))
            matrix = np.zeros((n, min(COLUMNS, len(both) - first)), dtype=np.float32)
            matrix[w[a:b], p[a:b] - first] = 1
            sides.append(matrix)
        total += sides[0] @ sides[1].T
    return total[at_i, at_j].astype(np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component under the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance, BANDS * ROWS, STEP)

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        """Links of one pair of blocks: for each class its links, and edges that connect what is linked."""
        _, low, high = key
        parts = [group[group["block"] == low], group[group["block"] == high]] if low != high else [group, group]
        names = [p["class"].to_numpy() for p in parts]
        signatures = [np.frombuffer(b"".join(p["signature"]), dtype=np.uint32).reshape(len(p), -1) for p in parts]
        sets = [[np.frombuffer(s, dtype=np.uint64) for s in p["shingles"]] for p in parts]
        sizes = [np.array([len(s) for s in side], dtype=np.float64) for side in sets]
        copies = [p["copies"].to_numpy() for p in parts]
        links, edges = [np.zeros(len(n), dtype=np.int64) for n in names], []
        if all(len(n) for n in names):
            mask = np.minimum(sizes[0][:, None], sizes[1][None, :]) >= threshold * np.maximum(sizes[0][:, None], sizes[1][None, :]) - 1e-9
            if low == high:
                mask &= np.arange(len(names[0]))[:, None] < np.arange(len(names[0]))[None, :]
            i, j = _surviving(*signatures, mask, least)
            if len(i):
                common = _shared(*sets, i, j)
                real = common >= threshold * (sizes[0][i] + sizes[1][j] - common) - 1e-9
                i, j = i[real], j[real]
                np.add.at(links[0], i, copies[1][j])
                np.add.at(links[1], j, copies[0][i])
                shift = 0 if low == high else len(names[0])
                every = names[0] if low == high else np.concatenate(names)
                roots = _roots(len(every), i, j + shift)
                edges = [(every[k], every[r]) for k, r in enumerate(roots.tolist()) if k != r]
        if low == high:
            counted = list(zip(names[0], links[0] + links[1], strict=True))
        else:
            counted = [c for n, l in zip(names, links, strict=True) for c in zip(n, l, strict=True)]
        counted = [(c, None, n) for c, n in counted if n]
        return pd.DataFrame(counted + [(a, b, 0) for a, b in edges], columns=["class", "other", "links"]).astype({"links": "int64"})

    return run


def jaccard_join(docs: DataFrame, threshold: float = 0.8, size: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """Per document row: doc_id, row, class_id and class_row (the least of its group of linked documents) and n_links (the
    documents whose shingles have at least the threshold's Jaccard similarity with its own, copies included).

    Shingles are runs of size words; a shorter text, unless it has no word, is one shingle. Texts
    without words, null ones too, link to nothing and are groups of their own. A null doc_id is
    replaced by no id: its row is a group of its own, but not compared. Repeated rows count as copies
    of each other; an empty table stays empty; other columns are ignored. Similarity is exact up to
    collisions of 64-bit shingle hashes; a linked pair is missed with a probability below 5e-8 for
    want of a band in common, and 2e-5 by pruning. A text's length sets its own cost alone.
    """
    small_batches(docs.sparkSession)
    sketch = written(sketches(docs, size), "sketches")
    held = sketch.where("class IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(held.groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")).withColumn("doc_id", F.col("least.doc_id")), "classes")
    candidates = written(_candidates(classes, threshold, tolerance), "candidates")
    sized = candidates.join(classes.select("class", "doc_id", "copies", "n_shingles"), "class")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_CLASSES, F.col("shingles_in") / BLOCK_SHINGLES)).cast("int")
    counts = sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles_in")).select("root", blocks.alias("blocks"))
    wanted = written(sized.join(counts, "root").select("class", "doc_id", "root", "copies", "blocks", F.pmod(F.xxhash64("class"), "blocks").cast("int").alias("block")), "wanted")
    members = _sets(docs, wanted, size)
    paired = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "class", "copies", "signature", "shingles"
    )
    found = written(paired.groupBy("root", "low", "high").applyInPandas(_compare(threshold, tolerance), "class binary, other binary, links long"), "links")
    groups = components(found.where("other IS NOT NULL").select(F.col("class").alias("u"), F.col("other").alias("v"))).select(F.col("node").alias("class"), "root")
    links = found.where("other IS NULL").groupBy("class").agg(F.sum("links").alias("links"))
    labelled = classes.select("class", "least", "copies").join(groups, "class", "left").join(links, "class", "left").withColumn("root", F.coalesce("root", "class"))
    labelled = labelled.select("class", "root", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = labelled.groupBy("root").agg(F.min("least").alias("first"))
    named = labelled.join(least, "root").select("class", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("class_row"), "n_links")
    return sketch.select("doc_id", "row", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class")).join(named, "class", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "row", F.coalesce("class_row", "row").alias("class_row")
    )


def representatives(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """One row of docs for each group of jaccard_join(): that with the least doc_id, of rows equal in id and text one; all
    columns stay. Texts without words and rows without a doc_id are groups of their own, and stay."""
    joined = written(jaccard_join(docs, threshold, size), "groups")
    others = joined.where("doc_id IS NOT NULL AND (doc_id <> class_id OR row <> class_row)").select("doc_id", "row")
    same = written(joined.where("doc_id IS NOT NULL AND doc_id = class_id AND row = class_row").groupBy("doc_id", "row").count().where("count > 1").select("doc_id", "row"), "repeated")
    if same.isEmpty():
        return without_rows(docs, others)
    repeated = docs.withColumn("__row", row_key()).join(same.select(F.col("doc_id").alias("__id"), F.col("row").alias("__same")), (F.col("doc_id") == F.col("__id")) & (F.col("__row") == F.col("__same")), "left_semi")
    return without_rows(docs, others.union(same)).unionByName(repeated.dropDuplicates(["doc_id", "__row"]).drop("__row"))


def digest(docs: DataFrame) -> DataFrame:
    return jaccard_join(docs).select("doc_id", "class_id", "n_links")

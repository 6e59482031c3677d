"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into segments of two bits, and its embedding is
the vector of their bit counts.  The Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints.  The segments form
``k // 2 + 1`` blocks, so two fingerprints that differ in at most ``k`` bits
have a block whose embeddings are at Manhattan distance at most one.  A grid
over each block's count vectors finds these pairs: a fingerprint sits in the
cell of its own counts and probes the cells with one count raised by one
(one direction is enough for unordered pairs).  Every candidate is verified
exactly by its differing bits.

Identical fingerprints are merged before the join.  A task reduces the links
it verifies to a spanning forest of the fingerprints it holds, so a dense
group of n fingerprints yields a few n links and never all pairs; cells above
``CELL_ROWS`` rows are dealt out as pairs of chunks to several tasks.

Defined results: a null, empty or blank text has fingerprint zero and is
linked like any other; a null document id takes part, but is never the name
of a component unless the component has no other; repeated rows share their
fingerprint; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.llm import util
from earlywarn.llm.components import components

SEED = 42
CELL_ROWS = 1 << 15  # a larger grid cell is split into pairs of chunks
TASK_ROWS = 2_000_000  # grid rows for one task
PAIRS_AT_ONCE = 1 << 21  # candidate pairs compared at a time
SHINGLES_AT_ONCE = 1 << 16


def bit_votes(shingles: list[bytes]) -> int:
    """Fingerprint of one text: bits set in over half of the shingle hashes."""
    import numpy as np
    import xxhash

    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(shingles), SHINGLES_AT_ONCE):
        part = shingles[k : k + SHINGLES_AT_ONCE]
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), dtype="<u8", count=len(part))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(shingles), bitorder="little")
    return int(bits.view("<u8")[0])


def text_shingles(text: str | None, size: int) -> list[bytes]:
    """Word shingles of a text, repeats included: A-Z lower-cased, words are
    runs of other than ASCII white space, joined by single blanks."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    out, begin, end = [], 0, sum(map(len, words[:size])) + size - 1
    for first, after in zip(words, words[size:]):
        out.append(line[begin:end])
        begin += len(first) + 1
        end += len(after) + 1
    out.append(line[begin:end])
    return out


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, row: Column | None = None
) -> DataFrame:
    """id and fp (the 64 bits as a signed long) of every row; ``row``, a long,
    is passed on in place of the id."""
    util.require(df, id_col, text_col)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in rows:
            fps = [bit_votes(s) if (s := text_shingles(t.as_py(), shingle)) else 0 for t in batch.column(1)]
            fp = np.array(fps, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    name = F.col(id_col) if row is None else row
    rows = df.select(name.cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def block_segments(k: int) -> list[list[int]]:
    """The 32 two-bit segments in ``k // 2 + 1`` blocks of even sizes."""
    n = k // 2 + 1
    edges = [round(32 * b / n) for b in range(n + 1)]
    return [list(range(a, b)) for a, b in zip(edges, edges[1:])]


def grid_rows(fps: DataFrame, k: int) -> DataFrame:
    """One row per cell a fingerprint sits in (probe = 0) or probes (probe = 1).

    A cell number is the block's count vector, three values a segment, plus
    the block's offset.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        blocks = block_segments(k)
        for batch in rows:
            for at in range(0, batch.num_rows, 1 << 15):
                part = batch.column(0).slice(at, 1 << 15)
                fp = part.to_numpy().view(np.uint64)
                counts = [((fp >> np.uint64(2 * s)) & 1) + ((fp >> np.uint64(2 * s + 1)) & 1) for s in range(32)]
                cells, owners, probes, offset = [], [], [], 0
                for block in blocks:
                    home = np.zeros(len(fp), dtype=np.int64)
                    for i, s in enumerate(block):
                        home += counts[s].astype(np.int64) * 3**i
                    home += offset
                    cells.append(home)
                    owners.append(fp)
                    probes.append(np.zeros(len(fp), dtype=np.int8))
                    for i, s in enumerate(block):
                        may = counts[s] < 2
                        cells.append(home[may] + 3**i)
                        owners.append(fp[may])
                        probes.append(np.ones(int(may.sum()), dtype=np.int8))
                    offset += 3 ** len(block)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(cells), pa.int64()),
                        pa.array(np.concatenate(owners).view(np.int64), pa.int64()),
                        pa.array(np.concatenate(probes), pa.int8()),
                    ],
                    ["cell", "fp", "probe"],
                )

    return fps.select("fp").mapInArrow(run, "cell long, fp long, probe byte")


def links(fps: DataFrame, k: int) -> DataFrame:
    """Links (a, b) that join the fingerprints of ``fps`` (distinct, written)
    as all pairs within ``k`` bits would: a spanning forest of each task."""
    rows = grid_rows(fps, k)
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    totals = sizes.agg(F.sum("size").alias("n"), F.max("size").alias("top")).first()
    rows = rows.withColumn("i", F.lit(0)).withColumn("j", F.lit(0)).withColumn("c", F.lit(0))
    if totals.top is not None and totals.top > CELL_ROWS:
        # every pair of chunks of a large cell meets in one task of its own
        chunks = sizes.filter(F.col("size") > CELL_ROWS).select("cell", F.ceil(F.col("size") / CELL_ROWS).alias("k"))
        chunk = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
        meets = F.transform(
            F.sequence(F.lit(0), F.col("k").cast("int") - 1),
            lambda o: F.struct(F.least(o, F.col("c")).alias("i"), F.greatest(o, F.col("c")).alias("j")),
        )
        rows = (
            rows.drop("i", "j", "c")
            .join(chunks, "cell", "left")
            .withColumn("k", F.coalesce("k", F.lit(1)))
            .withColumn("c", chunk)
            .withColumn("ij", F.explode(meets))
            .select("cell", "fp", "probe", F.col("ij.i").alias("i"), F.col("ij.j").alias("j"), "c")
        )
    parts = util.tasks_for(fps, totals.n or 0, TASK_ROWS)
    dealt = rows.select("cell", "i", "j", "c", "probe", "fp").repartition(parts, "cell", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = [b for b in batches if b.num_rows]
        if not table:
            return
        cell, i, j, c, probe, fp = (np.concatenate([b.column(x).to_numpy() for b in table]) for x in range(6))
        order = np.lexsort((probe, j, i, cell))
        cell, i, j, c, probe = (x[order] for x in (cell, i, j, c, probe))
        fp = fp[order].view(np.uint64)
        n = len(fp)
        new = np.ones(n, dtype=bool)
        new[1:] = (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        ends = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
        homes = np.flatnonzero(probe == 0)
        partners = ends[homes] - homes - 1  # the later rows of the cell: its homes, then its probes
        homes, partners = homes[partners > 0], partners[partners > 0]
        forest = np.zeros((0, 2), dtype=np.uint64)
        done = np.cumsum(partners)
        at = 0
        while at < len(homes):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS_AT_ONCE)))
            p, h = partners[at:to], homes[at:to]
            left = np.repeat(h, p)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(p) - p, p)
            near = np.bitwise_count(fp[left] ^ fp[right]) <= k
            near &= fp[left] != fp[right]
            near &= (i[left] == j[left]) | (c[left] != c[right])  # pairs inside a chunk meet in (i, i)
            left, right = left[near], right[near]
            if len(left):
                forest = spanning_forest(np.concatenate([forest, np.stack([fp[left], fp[right]], axis=1)]))
            at = to
        if len(forest):
            yield pa.RecordBatch.from_arrays(
                [pa.array(forest[:, x].copy().view(np.int64), pa.int64()) for x in (0, 1)], ["a", "b"]
            )

    return dealt.mapInArrow(run, "a long, b long")


def spanning_forest(pairs):
    """Star links (smallest member, other member) of the groups that ``pairs`` join."""
    import numpy as np

    names, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    member = np.flatnonzero(root != np.arange(len(names)))
    return np.stack([names[root[member]], names[member]], axis=1)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4
) -> DataFrame:
    """id, fp (signed long) and component_id: the smallest id reachable over
    links of at most ``max_bits`` differing bits, itself included."""
    prints = util.cut(fingerprints(df, id_col, text_col, shingle), "simhash-fp")
    distinct = util.cut(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    named = rooted(distinct, max_bits)
    smallest = util.cut(named.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-names")
    # a group of copies is one row of ``named``; the join back to all rows has a
    # plain shuffle on both sides, which adaptive execution splits where skewed
    names = util.cut(named.join(smallest, "root").select("fp", "component_id"), "simhash-members")
    return prints.join(names, "fp").select("id", "fp", "component_id")


def rooted(distinct: DataFrame, max_bits: int) -> DataFrame:
    """``distinct`` (written: fp, once each, and first) with the root of every
    fingerprint's component."""
    edges = util.cut(links(distinct, max_bits), "simhash-links")
    roots = components(edges, "a", "b")  # node, root: linked fingerprints only
    return util.cut(
        distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
            distinct["fp"], "first", F.coalesce("root", distinct["fp"]).alias("root")
        ),
        "simhash-roots",
    )


def one_of_each(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4
) -> DataFrame:
    """One row of ``df`` for every group of near-duplicates: that of the
    smallest id, null ids last; of rows of equal id that of the smallest hash
    of its text, then of all its columns, then any one."""
    row = "__simhash_row"
    numbered = util.cut(df.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    prints = util.cut(fingerprints(numbered, id_col, text_col, shingle, F.col(row)), "simhash-fp")
    order = F.struct(
        F.col(id_col).isNull().alias("unnamed"),
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(text_col).alias("text"),
        F.xxhash64(*df.columns).alias("all"),
        F.col(row).alias("row"),
    )
    facts = numbered.select(F.col(row), order.alias("order")).join(prints, F.col(row) == F.col("id"))
    distinct = util.cut(facts.groupBy("fp").agg(F.min("order").alias("first")), "simhash-distinct")
    stay = rooted(distinct, max_bits).groupBy("root").agg(F.min("first").alias("first"))
    stay = stay.select(F.col("first.row").alias("__simhash_stay"))
    return numbered.join(stay, F.col(row) == F.col("__simhash_stay"), "left_semi").select(*df.columns)

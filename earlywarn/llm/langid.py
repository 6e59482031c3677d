"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built.  A text is
parsed against it into phrases, each the longest match of what is left, and
the phrases needed, times the bits that name a place in the labelled text,
per letter, estimate the cross entropy.  The language needing the fewest
normalised phrases wins.

Letters are lower-cased; every run of other characters counts as one blank.
Parsing starts anew every ``BLOCK`` characters, so texts of any length are
parsed as equal blocks, side by side.  A letter that no labelled text has
fits no language and is a phrase of its own everywhere.

The automata are fitted on a bounded sample of the labelled rows
(``sample_docs`` texts a language, ``sample_chars`` characters of each,
chosen by a hash of the id); prediction reads every text in whole.

Defined results: a null text, or one without a letter, is ``und`` with score
0; ties go to the first language in code-point order; with no labelled rows
every text is ``und``; null labels are not learned; repeated rows are
predicted one by one; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.llm import util

BLOCK = 1024
UNKNOWN = "und"
SAMPLE_DOCS = 32
SAMPLE_CHARS = 1000
PARSE_AT_ONCE = 1 << 22  # characters parsed side by side
PREDICTED = "id long, lang_pred string, score double, bits double"


def sample(df: DataFrame, id_col: str, text_col: str, label_col: str, docs: int, chars: int) -> list[tuple[str, str]]:
    """(language, text) of the bounded sample, in a fixed order."""
    lang = F.col(label_col).cast("string")
    labelled = df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}  # a row per language
    if not counts:
        return []
    n = F.create_map(*[F.lit(x) for item in counts.items() for x in item])[lang]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    rows = (
        labelled.filter(util.thinned(F.xxhash64(F.col(id_col).cast("string")), docs, n))
        .select(
            F.col(label_col).cast("string").alias("lang"),
            F.xxhash64(F.col(id_col).cast("string")).alias("h"),
            F.substring(text_col, 1, chars).alias("text"),
        )
        .withColumn("rank", rank)
        .filter(F.col("rank") <= docs)
        .orderBy("lang", "rank")
        .collect()
    )
    return [(r.lang, r.text) for r in rows]


@functools.lru_cache(maxsize=4)
def letter_codes(alphabet: str):
    """Code of every code point: 0 for a character that is no letter, 1 and up
    for the alphabet, the last code for other letters."""
    import sys

    import numpy as np

    other = len(alphabet) + 1
    codes = np.zeros(sys.maxunicode + 1, dtype=np.uint8 if other < 256 else np.uint16)
    place = {c: i + 1 for i, c in enumerate(alphabet)}
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if c.isalpha():
            codes[point] = place.get(c.lower()[0], other)
    return codes


def encode(text: str, codes):
    """Codes of a text, with every run of non-letters as one 0."""
    import numpy as np

    at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = codes[at]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def suffix_automaton(text: list[int], width: int):
    """Transition table (states x width) of the suffix automaton of ``text``;
    -1 where no substring goes on."""
    import numpy as np

    link, length, step = [-1], [0], [{}]
    last = 0
    for c in text:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    table = np.full((len(step), width), -1, dtype=np.int64)
    for s, edges in enumerate(step):
        for c, t in edges.items():
            table[s, c] = t
    return table


class Model:
    """Languages, alphabet and one parsing table a language.

    Entry ``[state * width + code]`` holds ``2 * width * next + ended``:
    where no substring goes on, a phrase has ended and the next one begins
    with this character, from the first state.
    """

    def __init__(self, texts: list[tuple[str, str]]):
        import numpy as np

        self.languages = sorted({lang for lang, _ in texts})
        self.alphabet = "".join(sorted({c.lower()[0] for _, t in texts for c in t if c.isalpha()}))
        self.width = len(self.alphabet) + 2
        self.tables, self.phrase_bits = [], []
        for lang in self.languages:
            # blanks on both sides keep the texts of a language apart
            learned = " ".join(t for x, t in texts if x == lang)
            codes = encode(f" {learned} ", letter_codes(self.alphabet))
            table = suffix_automaton(codes.tolist(), self.width)
            # one more state follows a character that the language lacks: its phrase ends at once
            lone = len(table)
            first = np.where(table[0] < 0, lone, table[0])
            table = np.vstack([table, np.full((1, self.width), -1)])
            ended = table < 0
            table = np.where(ended, first[None, :], table)
            ended[0] = False  # before the first phrase there is none to end
            self.tables.append((2 * self.width * table + ended).astype(np.int32).ravel())
            self.phrase_bits.append(float(np.log2(max(2, len(codes)))))

    def phrases(self, blocks):
        """Phrases of each block (rows of codes, padded by -1) in each language."""
        import numpy as np

        n, size = blocks.shape
        lengths = (blocks >= 0).sum(axis=1)
        order = np.argsort(-lengths, kind="stable")
        columns = np.ascontiguousarray(blocks[order].T)
        active = n - np.searchsorted(np.sort(lengths), np.arange(size), side="right")
        out = np.zeros((len(self.languages), n), dtype=np.int64)
        for k, table in enumerate(self.tables):
            state = np.zeros(n, dtype=np.int32)
            count = np.zeros(n, dtype=np.int32)
            for t in range(size):
                m = int(active[t])
                if not m:
                    break
                entry = table[state[:m] + columns[t, :m]]
                count[:m] += entry & 1
                state[:m] = entry >> 1
            out[k, order] = count + (lengths[order] > 0)  # the last phrase ends with the block
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, bits a character in whole phrases) of every text."""
        import numpy as np

        codes = letter_codes(self.alphabet)
        coded = [encode(t, codes) if t else np.zeros(0, dtype=codes.dtype) for t in texts]
        chars = np.array([len(c) for c in coded], dtype=np.int64)
        letters = np.array([int((c > 0).sum()) for c in coded], dtype=np.int64)
        pieces = -(-chars // BLOCK)
        blocks = np.full((int(pieces.sum()), BLOCK), -1, dtype=np.int32)
        row = 0
        for c, p in zip(coded, pieces):
            if p:
                blocks[row : row + p].reshape(-1)[: len(c)] = c
                row += p
        owner = np.repeat(np.arange(len(texts)), pieces)
        bits = np.zeros((len(self.languages), len(texts)))
        whole = np.zeros_like(bits)
        if len(blocks) and self.languages:
            found = self.phrases(blocks)
            for k in range(len(self.languages)):
                total = np.bincount(owner, weights=found[k], minlength=len(texts))
                bits[k] = total * self.phrase_bits[k] / np.maximum(chars, 1)
                # the last phrase of a block is cut short; without it a text of a few letters counts fairly
                whole[k] = (total - pieces) * self.phrase_bits[k] / np.maximum(chars, 1)
        out = []
        for d in range(len(texts)):
            if not letters[d] or not self.languages:
                out.append((UNKNOWN, 0.0, None))
                continue
            ranked = np.argsort(bits[:, d], kind="stable")
            best = bits[ranked[0], d]
            # share of the second language's bits that the winner saves
            score = 1.0 if len(ranked) == 1 else float(1.0 - best / bits[ranked[1], d])
            out.append((self.languages[ranked[0]], min(1.0, max(0.0, score)), float(whole[ranked[0], d])))
        return out

    def most_bits(self) -> float:
        """Bits a character of a text whose phrases have two characters on average."""
        return max(self.phrase_bits, default=0.0) / 2


def fit(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS,
) -> Model:
    """Automata of the labelled rows of ``df`` (a bounded sample of them)."""
    util.require(df, id_col, text_col, label_col)
    return Model(sample(df, id_col, text_col, label_col, sample_docs, sample_chars))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (0 to 1) and bits (a character) for every row."""
    util.require(df, id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast(model)  # its size is set by the sample's bounds

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from earlywarn.llm.tokens import batches

        for batch in rows:
            for a, b, texts in batches(batch.column(1), PARSE_AT_ONCE):
                found = sent.value.predict(texts)
                lang, score, bits = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(lang, pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array(bits, pa.float64()),
                    ],
                    ["id", "lang_pred", "score", "bits"],
                )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PREDICTED)


def language(model: Model, text: Column, spark) -> Column:
    """The prediction for ``text`` as a struct (lang_pred, score, bits), for
    use beside a row's other columns."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, bits double")
    def found(column: pa.Array) -> pa.Array:
        from earlywarn.llm.tokens import batches

        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        rows = [r for _, _, texts in batches(column, PARSE_AT_ONCE) for r in sent.value.predict(texts)]
        lang, score, bits = zip(*rows) if rows else ((), (), ())
        kinds = (pa.string(), pa.float64(), pa.float64())
        return pa.StructArray.from_arrays(
            [pa.array(x, k) for x, k in zip((lang, score, bits), kinds)], ["lang_pred", "score", "bits"]
        )

    # read by a filter and a projection: it must not be evaluated for each of them
    return found.asNondeterministic()(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents set aside for testing: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def rejected(pred: Column, bits: Column, most_bits: float) -> Column:
    """Documents without a language: no letters, or phrases of fewer than two
    characters on average in the best language."""
    return (pred == UNKNOWN) | (bits > F.lit(most_bits))

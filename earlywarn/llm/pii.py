"""Personal data: fixed patterns and a trained character tagger.

Base spans follow fixed patterns (e-mail, IP address, payment card, phone).
A character-level bidirectional LSTM with CRF transitions, trained in numpy
on labelled spans of a bounded sample, adds spans the patterns miss: texts
are cut into overlapping windows, every window is decoded, and the spans of
all windows of a text are reconciled globally - parts of one span seen by
two windows are joined, of spans that cross the stronger stays, base spans
stay in any case.

A span needs a digit or an at sign, as every kind has one; a window without
either cannot give a span and is not decoded.  Base spans are found in time
linear in the text.

Defined results: a null text counts as empty; surrogates and control
characters are other characters; repeated rows are treated one by one; with
no labelled span in the sample nothing is added; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.llm import util
from earlywarn.llm.tagger import Tagger, character_codes

KINDS = ("email", "ip", "card", "phone")  # their order breaks ties of start
WINDOW, STRIDE = 128, 96
SAMPLE_DOCS = 384  # texts of the labelled sample
SAMPLE_CHARS = 20_000  # longer texts are not sampled
EXAMPLES = 768  # training windows
MARGIN = 4.0  # least strength of an added span (log-odds against being outside)
DECODE_AT_ONCE = 2048  # windows
TRIGGER = re.compile(r"[0-9@]")

# fixed values: the patterns of the base spans
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int, int]  # start, end, number of the kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), 0
            pos = m.end()
        at = text.find("@", max(pos, at + 1))


def addresses(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        if len(parts) < 4:
            continue
        begin = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield begin, end, 1
            begin = end + 1


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end(), 2


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.start(), m.end(), 3


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind."""
    if not TRIGGER.search(text):
        return []
    out = [*emails(text), *addresses(text), *cards(text)]
    if "+" in text:
        out += phones(text)
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def window_starts(n: int) -> list[int]:
    return [0] if n <= WINDOW else [*range(0, n - WINDOW + STRIDE, STRIDE)]


def tags_of(spans: list[Span], n: int):
    """Tag of each character; of overlapping spans the first one counts."""
    import numpy as np

    out = np.zeros(n, dtype=np.int64)
    for start, end, kind in spans:
        if not out[start:end].any():
            out[start] = 1 + 2 * kind
            out[start + 1 : end] = 2 + 2 * kind
    return out


def examples(texts: list[str], limit: int = EXAMPLES):
    """Windows of labelled texts: those with a span, and as many others that
    hold a trigger; arrays of codes, masks and tags."""
    import numpy as np

    rng = np.random.default_rng(3)
    hit, miss = [], []
    for text in texts:
        spans = base_spans(text)
        codes, tags = character_codes(text), tags_of(spans, len(text))
        trigger = np.array([c in "0123456789@" for c in text])
        for s in {s for i, _, _ in spans for s in (i // STRIDE * STRIDE, max(0, i - int(rng.integers(WINDOW))))}:
            hit.append((codes[s : s + WINDOW], tags[s : s + WINDOW]))
        for i in rng.permutation(np.flatnonzero(trigger & (tags == 0)))[:4]:
            s = max(0, int(i) - int(rng.integers(WINDOW)))
            if not tags[s : s + WINDOW].any():
                miss.append((codes[s : s + WINDOW], tags[s : s + WINDOW]))
        if len(text) > WINDOW:
            s = int(rng.integers(len(text) - WINDOW))
            if not tags[s : s + WINDOW].any():
                miss.append((codes[s : s + WINDOW], tags[s : s + WINDOW]))
    pick = lambda x, n: [x[i] for i in rng.permutation(len(x))[:n]]
    rows = pick(hit, 2 * limit // 3)
    rows += pick(miss, limit - len(rows))
    x = np.zeros((len(rows), WINDOW), dtype=np.int64)
    t = np.zeros_like(x)
    for i, (c, g) in enumerate(rows):
        x[i, : len(c)] = c
        # a span cut off at the left edge goes on with I; the first tag must be B
        g = g.copy()
        if g[0] > 0 and g[0] % 2 == 0:
            g[0] -= 1
        t[i, : len(g)] = g
    return x, (x > 0).astype(np.int8), t, len(hit)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    """Train on a bounded sample: ``SAMPLE_DOCS`` texts of at most
    ``SAMPLE_CHARS`` characters, chosen by a hash of the id among the texts
    with a digit or an at sign; their labelled spans are the base spans."""
    util.require(df, id_col, text_col)
    text = F.col(text_col)
    some = df.filter(text.rlike(r"[0-9][0-9. -]{5}|@") & (F.char_length(text) <= SAMPLE_CHARS))
    some = some.select(text.alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    some = some.filter(util.thinned(F.col("h"), SAMPLE_DOCS, some.count()))

    def train(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for batch in rows for t in batch.column(0).to_pylist()]
        x, mask, tags, labelled = examples(texts)
        if labelled:
            model = Tagger(len(KINDS))
            model.fit(x, mask, tags)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.single())])], ["model"])

    # the sample is one partition of bounded size; it trains where tasks run, on one core
    sample = some.orderBy("h", "text").limit(SAMPLE_DOCS).select("text").coalesce(1)
    found = sample.mapInArrow(train, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def tagged_spans(tags, margins) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, strength) of the spans of one window."""
    out = []
    i, n = 0, len(tags)
    while i < n:
        if tags[i] > 0:
            kind, j = (int(tags[i]) - 1) // 2, i + 1
            while j < n and tags[j] == 2 + 2 * kind:
                j += 1
            out.append((i, j, kind, float(margins[i:j].sum())))
            i = j
        else:
            i += 1
    return out


def reconcile(text: str, found: list[tuple[int, int, int, float]], base: list[Span]) -> list[Span]:
    """Added spans of a whole text from those of its windows."""
    joined: list[list] = []
    for s in sorted(found, key=lambda s: (s[2], s[0], s[1])):
        if joined and joined[-1][2] == s[2] and s[0] < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], s[1])
            joined[-1][3] = max(joined[-1][3], s[3])
        else:
            joined.append(list(s))
    taken = [(s, e) for s, e, _ in base]
    out = []
    for start, end, kind, strength in sorted(joined, key=lambda s: (-s[3], s[2], s[0])):
        while end > start and text[end - 1].isspace():
            end -= 1
        while end > start and text[start].isspace():
            start += 1
        if strength < MARGIN or not TRIGGER.search(text, start, end):
            continue
        if all(end <= s or start >= e for s, e in taken):
            taken.append((start, end))
            out.append((start, end, kind))
    return out


def added_spans(model: Tagger | None, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
    """Spans the tagger adds to each text."""
    import numpy as np

    out: list[list[Span]] = [[] for _ in texts]
    if model is None:
        return out
    at, rows = [], []
    for d, text in enumerate(texts):
        if not TRIGGER.search(text):
            continue
        codes = character_codes(text)
        hot = np.zeros(len(text) + 1, dtype=np.int64)
        np.cumsum(((codes >= 20) & (codes <= 29)) | (codes == 36), out=hot[1:])  # digits and the at sign
        for s in window_starts(len(text)):
            if hot[min(len(text), s + WINDOW)] > hot[s]:
                at.append((d, s))
                rows.append(codes[s : s + WINDOW])
    found: dict[int, list] = {}
    for k in range(0, len(rows), DECODE_AT_ONCE):
        part = rows[k : k + DECODE_AT_ONCE]
        x = np.zeros((len(part), WINDOW), dtype=np.int64)
        for i, c in enumerate(part):
            x[i, : len(c)] = c
        tags, margins = model.decode(x, x > 0)
        for i in np.flatnonzero((tags > 0).any(axis=1)):
            d, s = at[k + i]
            n = len(part[i])
            found.setdefault(d, []).extend((s + a, s + b, kind, m) for a, b, kind, m in tagged_spans(tags[i][:n], margins[i]))
    for d, spans in found.items():
        out[d] = reconcile(texts[d], spans, bases[d])
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


FOUND = "id long, base string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS)


def find_personal_data(df: DataFrame, model: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans (kind:start:end by start, comma-joined; code points,
    end exclusive), and the number of base spans of each kind."""
    util.require(df, id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from earlywarn.llm.tokens import batches

        names = ["id", "base", "spans", *[f"n_{k}" for k in KINDS]]
        for batch in rows:
            for a, b, texts in batches(batch.column(1), 4 << 20):
                texts = [t or "" for t in texts]
                bases = [base_spans(t) for t in texts]
                added = added_spans(sent.value, texts, bases)
                counts = [[sum(s[2] == k for s in x) for x in bases] for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([listed(x) for x in bases], pa.string()),
                        pa.array([listed([*x, *y]) for x, y in zip(bases, added)], pa.string()),
                        *[pa.array(c, pa.int64()) for c in counts],
                    ],
                    names,
                )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, FOUND)

"""Language of every text, by words, scripts and a path through the languages.

A word's script, from fixed code point ranges, leaves only the languages that
use this script. Each of them scores the word by its character pieces (one to
four characters with marks at the ends; a naive Bayes model over hashed
pieces). Viterbi over the words of a text, with a penalty for every switch,
labels spans. The label of a text is the language with most letters in its
spans, which the text's total score decides if two are even.

The fit reads at most ``SAMPLE`` labelled rows, spread over the languages, and
their whole texts; labelling sees every whole text.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import fold, held_out, table, written

SAMPLE = 4000  # labelled rows that the fit may read
MARGIN = 4  # times the share of rows that a sample of its size would take
SLICE = 1 << 18  # characters of a sampled text counted at once
PIECES = 1 << 16
SWITCH = 6.0
FOREIGN = -30.0  # score of a word in a language that does not use its script
CLIP = 8.0  # no word counts for more than this against a language
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
BORDER = re.compile(r"[\W\d_]")


def _with_marks() -> re.Pattern[str]:
    """Letters with the vowel signs and accents that follow them, which belong to the word."""
    marks = [c for c in range(0x300, 0x10000) if unicodedata.category(chr(c))[0] == "M"]
    ends = [i for i in range(len(marks)) if i + 1 == len(marks) or marks[i + 1] != marks[i] + 1]
    starts = [0, *(i + 1 for i in ends[:-1])]
    chars = "".join(f"\\u{marks[a]:04x}-\\u{marks[z]:04x}" for a, z in zip(starts, ends, strict=True))
    return re.compile(rf"[^\W\d_](?:[^\W\d_]|[{chars}])*")


MARKED = _with_marks()
BATCH = 1 << 22  # characters labelled at once
WORDS = 1 << 14  # words scored at once
# fixed values: first code point of each range and the script that starts there
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2E80, "han"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"), (0x30000, "other"),
]
_STARTS = [start for start, _ in SCRIPTS]
WHOLE = {"han", "kana", "thai"}  # scripts without spaces: their runs are cut into characters


def _runs() -> re.Pattern[str]:
    """Runs of one script, or single characters of a script without spaces."""
    ranges: dict[str, str] = {}
    for (start, name), end in zip(SCRIPTS, [*_STARTS[1:], 0x110000], strict=True):
        ranges[name] = ranges.get(name, "") + f"\\U{start:08x}-\\U{end - 1:08x}"
    return re.compile("|".join(f"[{chars}]" + ("" if name in WHOLE else "+") for name, chars in ranges.items()))


RUNS = _runs()


def script(word: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def words(text: str | None) -> list[str]:
    """Runs of letters of one script in lower case."""
    text = (text or "").lower()
    out = (LETTERS if text.isascii() or max(text) < "\u0300" else MARKED).findall(text)
    letters = "".join(out)
    if letters.isascii():
        return out
    if max(letters) >= "\u0370":
        out = [p for w in out for p in ([w] if w.isascii() else RUNS.findall(w))]
    if not letters.isalpha():  # fractions and the like count as word characters, but are no letters
        out = [w for w in out if any(map(str.isalpha, w))]
    return out


def pieces(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed pieces of all words, and the number of the word that each is of."""
    marked = "".join([f"<{w}>" for w in found])
    code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 2
    word = np.repeat(np.arange(len(found)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters to the end of the word
    value = np.zeros(len(code) + 1, np.uint64)
    hashes, of = [], []
    for n in (1, 2, 3, 4):
        value = value[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(n)
        inside = np.flatnonzero(left[: len(value)] >= n)
        mixed = value[inside]
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        hashes.append((mixed >> np.uint64(32)).astype(np.int64) % PIECES)
        of.append(word[inside])
    hashes.append(np.array([zlib.crc32(w.encode("utf-8", "replace")) % PIECES for w in found], np.int64))
    of.append(np.arange(len(found)))
    return np.concatenate(hashes), np.concatenate(of)


@dataclass
class Model:
    languages: list[str]
    piece_scores: np.ndarray  # (pieces, languages), log share of a piece, centred over the languages
    scripts: dict[str, np.ndarray]  # which languages use a script
    prior: np.ndarray
    known: dict[str, int] = field(default_factory=dict, repr=False)
    rows: list[np.ndarray] = field(default_factory=list, repr=False)

    def word_scores(self, found: list[str]) -> np.ndarray:
        """Scores of words in every language, 0 for the best; a script that no language was seen in says nothing."""
        hashes, word = pieces(found)
        n = len(found)
        columns = [np.bincount(word, self.piece_scores[hashes, i], n) for i in range(len(self.languages))]
        nobody = np.zeros(len(self.languages), bool)
        uses = np.array([self.scripts.get(name, nobody) for _, name in SCRIPTS])
        user = uses[np.searchsorted(_STARTS, np.fromiter((ord(w[0]) for w in found), np.int64, n), side="right") - 1]
        out = np.where(user, np.stack(columns, 1), -np.inf)
        top = out.max(1, keepdims=True)
        out = np.maximum(out - np.where(np.isfinite(top), top, 0.0), -CLIP)
        out = np.where(user, out, FOREIGN)
        return np.where(user.any(1, keepdims=True), out, 0.0).astype(np.float32)

    def word_ids(self, found: list[str]) -> np.ndarray:
        """Numbers of words, rows of ``scores``; words stay known until there are many."""
        known = self.known
        new = [w for w in dict.fromkeys(found) if w not in known]
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        self.rows += [self.word_scores(new[i : i + WORDS]) for i in range(0, len(new), WORDS)]
        return np.fromiter(map(known.__getitem__, found), np.int64, len(found))

    def scores(self) -> np.ndarray:
        if len(self.rows) > 1:
            self.rows[:] = [np.concatenate(self.rows)]
        return self.rows[0] if self.rows else np.zeros((0, len(self.languages)), np.float32)

    def forget(self, most: int = 300_000) -> None:
        if len(self.known) > most:
            self.known.clear()
            self.rows.clear()


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word, texts one after the other in ``scores``.

    All texts go forward together, word by word, longest first, so that the ones
    with a word at a place are a prefix. A step keeps the best language so far;
    whether staying is better than coming from it is one bit a language.
    """
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")  # texts with a word at this place
    value = np.zeros((len(size), scores.shape[1]), np.float32)
    best = np.zeros(len(scores), np.int16)
    stay = np.zeros(scores.shape, bool)
    for t in range(steps):
        n = active[t]
        at = start[:n] + t
        now = value[:n]
        if t:
            top = now.argmax(1)
            come = now[np.arange(n), top] - switch
            best[at] = top
            keep = now >= come[:, None]
            stay[at] = keep
            now = np.where(keep, now, come[:, None])
            now -= now.max(1, keepdims=True)
        value[:n] = now + scores[at]
    path = np.zeros(len(scores), np.int16)
    state = value.argmax(1)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = start[:n] + t
        path[at] = state[:n]
        if t:
            state[:n] = np.where(stay[at, state[:n]], state[:n], best[at])
    return path


def label(texts: list[str | None], model: Model, switch: float = SWITCH) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """(language, share of letters in its spans, spans) of every text; a span is (language, first word, words)."""
    model.forget()
    found = [words(t) for t in texts]
    lengths = np.array([len(f) for f in found], np.int64)
    flat = list(chain.from_iterable(found))
    ids = model.word_ids(flat)
    weights = np.fromiter(map(len, flat), np.float64, len(flat))
    scores = model.scores()[ids] if len(ids) else np.zeros((0, len(model.languages)), np.float32)
    path = viterbi(scores, lengths, switch)
    out = []
    ends = np.cumsum(lengths)
    for end, n in zip(ends.tolist(), lengths.tolist(), strict=True):
        if not n:
            out.append((UNKNOWN, 0.0, []))
            continue
        own = path[end - n : end]
        share = np.bincount(own, weights[end - n : end], len(model.languages))
        total = scores[end - n : end].sum(0, dtype=np.float64) + model.prior
        top = max(range(len(share)), key=lambda i: (share[i], total[i], -i))
        cut = np.flatnonzero(np.diff(own)) + 1
        begin = np.concatenate([[0], cut])
        sizes = np.diff(np.append(begin, n))
        spans = [(model.languages[int(own[b])], int(b), int(s)) for b, s in zip(begin, sizes, strict=True)]
        out.append((model.languages[top], float(share[top] / share.sum()), spans))
    return out


def _model(rows: list[tuple[str, bytes, dict]], priors: dict[str, int]) -> Model:
    languages = sorted(priors)
    counts = np.full((PIECES, len(languages)), 0.5)
    letters: dict[str, dict[str, float]] = {}
    for lang, blob, used in rows:
        i = languages.index(lang)
        counts[:, i] += np.frombuffer(blob)
        for name, n in used.items():
            letters.setdefault(lang, {})[name] = letters.get(lang, {}).get(name, 0.0) + n
    logs = np.log(counts / counts.sum(0))
    logs -= logs.mean(1, keepdims=True)
    scripts: dict[str, np.ndarray] = {}
    for i, lang in enumerate(languages):
        total = sum(letters.get(lang, {}).values())
        for name, n in letters.get(lang, {}).items():
            if n >= 0.02 * total:  # a stray word does not make a script a language's own
                scripts.setdefault(name, np.zeros(len(languages), bool))[i] = True
    seen = np.array([priors[x] for x in languages], float)
    return Model(languages, logs.astype(np.float32), scripts, np.log(seen / seen.sum()))


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in slices of about ``size`` characters that end between words."""
    at = 0
    while at < len(text):
        end = BORDER.search(text, at + size)
        end = end.end() if end else len(text)
        yield text[at:end]
        at = end


def _counts(batches: Iterator[pa.RecordBatch]):
    """Pieces and script letters of a part of the sample, by language."""
    totals: dict[str, np.ndarray] = {}
    letters: dict[str, dict[str, float]] = {}
    for batch in batches:
        for lang, text in ((lang.as_py(), text.as_py()) for lang, text in zip(batch.column(0), batch.column(1), strict=True)):
            total = totals.setdefault(lang, np.zeros(PIECES))
            used = letters.setdefault(lang, {})
            for part in slices(text):
                found = words(part)
                total += np.bincount(pieces(found)[0], minlength=PIECES)
                for word in found:
                    name = script(word)
                    used[name] = used.get(name, 0.0) + len(word)
    names = sorted(totals)
    yield pa.record_batch({
        "lang": pa.array(names, pa.string()), "counts": pa.array([totals[n].tobytes() for n in names], pa.binary()),
        "letters": pa.array([list(letters[n].items()) for n in names], pa.map_(pa.string(), pa.float64())),
    })


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model of the languages in ``lang``, from rows outside fold 1 with an id, text and lang; None if there is no such row.

    Every language gets an even part of the sample, one text for an id that several
    rows have, the smallest. Languages are collected to the driver with one count
    vector each. An empty table gives None.
    """
    known = docs.where((fold(F.col("doc_id")) != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.select("lang", F.col("doc_id").cast("bigint").alias("id"))
    priors = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not priors:
        return None
    each = max(1, sample // len(priors))
    # the smallest hashes of a language are in a known share of their range, but for a chance that ``MARGIN`` keeps out
    # of reach; so what meets to be ranked does not grow with the table
    most = {lang: min(1.0, MARGIN * (each + MARGIN) / n) for lang, n in priors.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for lang, share in most.items() for x in (lang, share)]), F.col("lang"))
    draw = F.xxhash64(F.lit(3), "id")
    few = known.withColumn("draw", draw).where((F.col("draw") / F.lit(2.0**64) + 0.5) <= limit)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))
    picked = few.withColumn("n", nth).where(F.col("n") <= each).select("lang", "id").distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "lang", "text").where(F.col("text").rlike(r"\p{L}"))
    # one text of each sampled id, however many rows have it
    texts = texts.join(F.broadcast(picked), ["lang", "id"]).groupBy("lang", "id").agg(F.min("text").alias("text"))
    rows = written(texts.select("lang", "text").repartition(8), "sample")
    found = rows.mapInArrow(_counts, "lang string, counts binary, letters map<string,double>").collect()
    return _model(sorted((r["lang"], bytes(r["counts"]), r["letters"]) for r in found), priors)


LABELLED = "lang_pred string, score double, spans array<struct<lang:string,first_word:int,n_words:int>>"


def with_language(docs: DataFrame, model: Model | None, switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """``(doc_id, lang_pred, score, spans)`` of every row. Score is the share of letters in the language's spans.

    A text without letters, or null, is ``und`` with score 0; so is every text
    without a model. A tie of letters goes by the total score, then by name. Texts
    of any length are labelled whole, repeated rows each for itself, an empty table
    stays empty, and columns but doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        fitted = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= BATCH):
                    chars += len(texts[end] or "")
                    end += 1
                found = label(texts[at:end], fitted, switch) if fitted else [(UNKNOWN, 0.0, [])] * (end - at)
                kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))
                names = ("lang", "first_word", "n_words")
                parts = [[dict(zip(names, s, strict=True)) for s in f[2]] if spans else [] for f in found]
                yield pa.record_batch({
                    "doc_id": ids.slice(at, end - at), "lang_pred": pa.array([f[0] for f in found], pa.string()),
                    "score": pa.array([f[1] for f in found], pa.float64()), "spans": pa.array(parts, kind),
                })
                at = end

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, f"doc_id bigint, {LABELLED}")


def op1(spark, folder: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, folder, "documents")
    out = with_language(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))

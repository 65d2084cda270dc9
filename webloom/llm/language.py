"""Language identification: script ranges narrow the candidates, Viterbi over word scores labels spans.

Training counts, for each language, the letters of each script range and the character n-grams (1 to 4, words between
marks, as 64-bit hashes) of a bounded sample of texts. A word's score in a language is the sum of the smoothed log
probabilities of its n-grams over the root of their number; only
languages that write at least SCRIPT_SHARE of their letters in the word's script are candidates (all of them, if none
is), the others get the lowest score. Words of one text form a chain: staying in a language is free, switching costs
SWITCH; Viterbi finds the best labels, and equal labels side by side are a span. The text's language is the one with
most letters in its spans, its score that share times the mean confidence of the winning labels.

The sample is bounded: the TRAIN_ROWS documents with the smallest hashes of doc_id that have a language and crc32(doc_id as
text) mod 5 not 0, down to the one that reaches TRAIN_BYTES of text; of rows with one doc_id and language the least text. They are
read whole but for n-gram counts kept to the TABLE most frequent n-grams a language.

Edge cases: null text and text without letters is `und` with score 0 and no spans; if no language was learned every text
is `und`; a null doc_id is in no fold (crc32 of empty text is 0: held out); ties go to the language first in code point
order; repeated rows get equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.common import map_slices

TRAIN_ROWS, TRAIN_BYTES = 3000, 64 << 20
FOLDS, HELD_OUT = 5, 0
TABLE = 30_000
SWITCH, SCRIPT_SHARE, MAX_N = 4.0, 0.02, 4
WORD_CACHE = 1 << 18
SEGMENT = 256

#: Script ranges of Unicode blocks (first code point, name).
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "NKo"), (0x0800, "Other"), (0x0860, "Syriac"), (0x0870, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Other"),
)
_STARTS = np.array([a for a, _ in SCRIPTS])
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
SCRIPT_NUMBER = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])
WORDS = re.compile(r"[^\W\d_]+")


def has_letter(word: str) -> bool:
    """Other numerals, such as superscripts, pass the pattern of WORDS."""
    return word.isalpha() or any(map(str.isalpha, word))


def scripts_of(words: list[str]) -> np.ndarray:
    """Number of the script of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return SCRIPT_NUMBER[np.searchsorted(_STARTS, first, side="right") - 1]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of all words, and the word of each."""
    text = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))  # letters to the end of the word
    hashes, owners = [], []
    h = np.zeros(len(text), np.uint64)
    for n in range(1, MAX_N + 1):
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h[: len(text) - n + 1] += text[n - 1 :] + np.uint64(n)
        ok = left >= n
        hashes.append(h[ok] ^ (h[ok] >> np.uint64(29)))
        owners.append(owner[ok])
    return np.concatenate(hashes), np.concatenate(owners)


class Model:
    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        n = len(self.langs)
        self.scripts = np.zeros((len(SCRIPT_NAMES), max(n, 1)), bool)
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        totals = []
        for k, lang in enumerate(self.langs):
            counts = Counter(w for t in texts[lang] for w in WORDS.findall(t.lower()) if has_letter(w))
            words, times = list(counts), np.array(list(counts.values()), np.int64)
            if not words:
                kept.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
                totals.append(0)
                continue
            letters = np.bincount(scripts_of(words), weights=times * np.fromiter(map(len, words), np.int64, len(words)), minlength=len(SCRIPT_NAMES))
            self.scripts[:, k] = letters / letters.sum() >= SCRIPT_SHARE
            h, owner = grams(words)
            found, place = np.unique(h, return_inverse=True)
            number = np.bincount(place, weights=times[owner]).astype(np.int64)
            best = np.lexsort((found, -number))[:TABLE]
            kept.append((found[best], number[best]))
            totals.append(int(number[best].sum()))
        self.grams = np.unique(np.concatenate([g for g, _ in kept])) if kept else np.empty(0, np.uint64)
        self.table = np.ones((len(self.grams) + 1, max(n, 1)))
        for k, (g, number) in enumerate(kept):
            self.table[np.searchsorted(self.grams, g), k] += number
            self.table[:, k] /= totals[k] + len(self.grams) + 1
        self.table = np.log(self.table).astype(np.float32)
        self._forget()

    def _forget(self):
        self.cache: dict[str, int] = {}
        self.matrix = np.empty((0, max(len(self.langs), 1)), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "matrix")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._forget()

    def word_scores(self, words: list[str]) -> np.ndarray:
        """words x languages, the best one 0."""
        h, owner = grams(words)
        at = np.searchsorted(self.grams, h)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != h)] = len(self.grams)
        n = np.bincount(owner, minlength=len(words))
        out = np.stack([np.bincount(owner, weights=self.table[at, k], minlength=len(words)) for k in range(len(self.langs))], 1) / np.sqrt(n)[:, None]
        can = self.scripts[scripts_of(words)]
        can |= ~can.any(axis=1, keepdims=True)
        out = np.where(can, out, np.where(can, out, np.inf).min(axis=1, keepdims=True) - 20)
        return (out - out.max(axis=1, keepdims=True)).astype(np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """words x languages; words met before are looked up."""
        if len(self.cache) > WORD_CACHE:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.cache]
        if new:
            self.matrix = np.concatenate([self.matrix, self.word_scores(new)])
            for w in new:
                self.cache[w] = len(self.cache)
        return self.matrix[np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))]


def _advance(scores, first, lengths, start, penalty):
    """Best scores at the end of each chain [first, first + length) that begins with the bonus start (chains x languages).

    Chains are sorted longest first and advance together. Also gives for each step and chain: which states stay, and where
    the others come from."""
    steps, back = int(lengths[0]) if len(lengths) else 0, []
    best = start + scores[first]
    ends = best.copy()
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="left")  # chains longer than t
    for t in range(1, steps):
        m = int(active[t - 1])
        best = best[:m]
        top = best.argmax(axis=1)
        moved = best[np.arange(m), top] - penalty
        stay = best >= moved[:, None]
        back.append((stay, top.astype(np.int32)))
        best = np.where(stay, best, moved[:, None]) + scores[first[:m] + t]
        ends[:m] = best
    return ends, back


def viterbi(scores: np.ndarray, first: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best labels of all words; the chains are [first, first + length).

    Chains are cut into segments of SEGMENT words. All segments advance together from every possible state before them; then
    the segments of a chain are joined, which fixes the state before and at the end of each, and one more advance from
    those gives the labels. So a step costs the same whatever the longest text."""
    labels, n_langs = np.zeros(len(scores), np.int64), scores.shape[1]
    counts = -(-lengths // SEGMENT)
    chain = np.repeat(np.arange(len(first)), counts)
    if not len(chain):
        return labels
    number = np.arange(len(chain)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = first[chain] + number * SEGMENT
    size = np.minimum(SEGMENT, lengths[chain] - number * SEGMENT)
    order = np.argsort(-size, kind="stable")
    enter = np.where(np.eye(n_langs, dtype=bool), 0, -penalty).astype(np.float32)  # before x first state
    start = np.where((number == 0)[:, None, None], np.float32(0), enter)  # segments x before x first
    through = np.empty((len(chain), n_langs, n_langs), np.float32)  # segments x before x last
    for s in range(n_langs):
        through[order, s] = _advance(scores, begin[order], size[order], start[order, s], penalty)[0]
    last_of = np.cumsum(counts) - 1
    before, best = np.zeros((len(chain), n_langs), np.int64), np.zeros((len(first), n_langs), np.float64)
    for j in range(int(counts.max())):
        c = np.flatnonzero(counts > j)
        at = last_of[c] - counts[c] + 1 + j
        total = best[c][:, :, None] + through[at] if j else through[at].astype(np.float64)
        before[at] = total.argmax(axis=1)
        best[c] = total.max(axis=1)
    ends, entry = np.zeros(len(chain), np.int64), np.zeros(len(chain), np.int64)
    state = best.argmax(axis=1)
    for j in range(int(counts.max()) - 1, -1, -1):
        c = np.flatnonzero(counts > j)
        at = last_of[c] - counts[c] + 1 + j
        ends[at], entry[at] = state[c], before[at, state[c]]
        state[c] = entry[at]
    _, back = _advance(scores, begin[order], size[order], start[order, entry[order]], penalty)
    state, at = ends[order].copy(), begin[order] + size[order] - 1
    labels[at] = state
    for t in range(len(back), 0, -1):
        stay, top = back[t - 1]
        m = len(top)
        state[:m] = np.where(stay[np.arange(m), state[:m]], state[:m], top)
        labels[begin[order[:m]] + t - 1] = state[:m]
    return labels


def fold(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from text and lang of a bounded sample outside the held-out fold."""
    rows = docs.where(fold(F.col("doc_id")) != HELD_OUT).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    order = (F.xxhash64("doc_id"), "doc_id")
    sizes = rows.groupBy("doc_id").agg(F.max(F.octet_length("text")).cast("bigint").alias("n")).orderBy(*order).limit(train_rows)
    before = F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over train_rows rows
    some = F.broadcast(sizes.withColumn("before", before).where(F.col("before") < TRAIN_BYTES).select("doc_id"))
    sample = rows.join(some, "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(sample, key=lambda r: (r["doc_id"], r["lang"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return Model(texts)


SCHEMA = "doc_id bigint, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def identify(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, and spans of one language (code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        langs = np.array(m.langs, object)

        def chains(texts, out):
            words, lengths, places = [], [], []
            for t in texts:
                if with_spans:
                    found = [x.span() for x in WORDS.finditer(t) if has_letter(x[0])]
                    own = [t[a:b].lower() for a, b in found]
                    places.append(found)
                else:
                    own = [x.lower() for x in WORDS.findall(t) if has_letter(x)]
                words += own
                lengths.append(len(own))
            lengths = np.array(lengths, np.int64)
            first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
            if not words or not m.langs:
                n = len(texts)
                return [out[k].extend([v] * n) for k, v in (("lang_pred", "und"), ("score", 0.0), ("spans", []))]
            scores = m.scores(words)
            labels = viterbi(scores, first, lengths)
            letters = np.fromiter(map(len, words), np.int64, len(words))
            owner = np.repeat(np.arange(len(texts)), lengths)
            n_langs = len(m.langs)
            by_lang = np.bincount(owner * n_langs + labels, weights=letters, minlength=len(texts) * n_langs).reshape(-1, n_langs)
            sure = np.exp(scores[np.arange(len(words)), labels]) / np.exp(scores).sum(axis=1)
            main = by_lang.argmax(axis=1)
            mine = labels == main[owner]
            weight = np.bincount(owner, weights=letters * sure * mine, minlength=len(texts))
            has = by_lang.sum(axis=1)
            confidence = weight / np.maximum(has, 1)
            out["lang_pred"] += [langs[k] if h else "und" for k, h in zip(main, has, strict=True)]
            out["score"] += np.clip(confidence, 0, 1).tolist()
            for k in range(len(texts)):
                spans = []
                if with_spans:
                    own = labels[first[k] : first[k] + lengths[k]]
                    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else []
                    spans = [{"start": places[k][a][0], "end": places[k][b - 1][1], "lang": langs[own[a]]} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                out["spans"].append(spans)

        def f(cols):
            out = {"doc_id": cols["doc_id"], "lang_pred": [], "score": [], "spans": []}
            chains([t or "" for t in cols["text"]], out)
            return out

        return f

    return map_slices(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), "text", make, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, fit(docs))
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score", F.size("spans").cast("bigint").alias("n_spans"))

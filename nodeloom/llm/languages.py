"""Languages of documents and of the segments of mixed documents, by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary; the probability of a word is the sum over
all its segmentations into pieces, by the forward algorithm. The probabilities are fitted by expectation maximisation
over a bounded labelled sample and mixed with those of all languages, so what no language knows speaks for none. The
sample is ``lang_samples`` (``MOST_SAMPLES`` sentences per language) and, fitted with it in a second step, about
``MOST_DOCUMENTS`` documents per language of at most ``MOST_CHARS`` characters whose label the first fit confirms.

Sentences and lines are scored by their words; quoted words, addresses, signs and words with letters of no sample are left
out. A sentence or line of few words counts half, as headings and debris are such, and if no sample knows any of them it
is set aside, whatever its marks. A Viterbi path over all others gives the segments: changing the language costs
``SWITCH``, more than a word can say.

The words of a batch are collected, those not met before are scored in one pass over all their lattices, and the scores
of a sentence are summed by their numbers. The languages are those of ``lang_samples``, in any script they use.

Defined results: null, empty and wordless texts have no segment, nor have a few words that no sample knows; sentences
without words belong to the segment around them; confidence is the posterior of the segment's language over its own
words; with no samples no text has a language; texts of any length are read whole; repeated rows each get their rows.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nodeloom.functions.visual import look_alikes, tables
from nodeloom.runtime import table

#: Vocabulary (a parameter), bounds of the labelled sample, rounds of fitting, longest piece in characters.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MOST_SAMPLES, MOST_DOCUMENTS, MOST_CHARS, ROUNDS, LONGEST = 2000, 500, 4000, 6, 12
#: Weight of the common distribution in each language's, share of each that comes from all segmentations alike and not
#: the likeliest, the most one word may say, and the cost of a change of language (nats).
COMMON, SPREAD, WORD_MOST, SWITCH = 0.1, 0.3, 4.0, 7.0
#: What the evidence of a word no sample has counts, and that of a sentence or line of few words, as headings and debris are.
UNSURE = 0.5
#: Words that a sentence or line must have to count in full, or at all if none of them is in the sample, remembered words per worker, and
#: words of a lattice pass, their longest length (longer ones are scored one by one), and texts taken at once.
FEW_WORDS, CACHE, PASS, SHORT, TEXTS = 4, 200_000, 4096, 48, 1000
#: Weight of a letter in products of piece probabilities, which keeps them in range and divides out.
LETTER = 16.0

# Other ways to write the codes of languages, a help for reading labels only.
SPELLINGS = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french francais français", "es": "spa spanish espanol español castellano",
    "it": "ita italian italiano", "pt": "por portuguese portugues português", "nl": "nld dut dutch nederlands", "ru": "rus russian русский",
}


def label_code(label: str | None, langs) -> str | None:
    """The language of ``langs`` that a label written in any way (``EN``, ``eng``, ``en-GB``) names; None if it names none."""
    if not label:
        return None
    low = label.strip().lower()
    for x in (low, re.split(r"[-_ .@]", low)[0]):
        for k in langs:
            if x == k.lower() or x in SPELLINGS.get(k.lower(), "").split():
                return k
    return None


@lru_cache(2)
def vocabulary(path: str = VOCABULARY) -> frozenset[str]:
    """Lower-case pieces of letters, with '▁' where a word begins."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = set()
    for i in range(sp.vocab_size()):
        p = sp.id_to_piece(i).lower()
        if p.strip("▁") and len(p) <= LONGEST and all(c.isalpha() or unicodedata.combining(c) for c in p.lstrip("▁")):
            out.add(p)
    return frozenset(out)


_WORD = regex.compile(r"[\p{L}\p{M}]+")
_LETTERS = re.compile("[A-Za-z]+")
# What is no running text, by the character that gives it away: a sentence is searched only for what it may hold.
_OUTS = (
    ("@", r"\S+@\S+"), ("/.", r"https?://\S+|www\.\S+"), ("\"", r"\"[^\"\n]{0,200}\""), ("“", r"“[^”\n]{0,200}”"), ("„", r"„[^“”\n]{0,200}[“”]"), ("«", r"«[^»\n]{0,200}»"), ("/", r"/[^/\n\d:]{1,60}/"),
    ("&", r"&\w+;"), ("<", r"<[^>\n]{0,100}>"), ("'’", r"\b[^\W\d_]{1,6}['’](?:s|ll|ve|m|re|d|t)\b"), ("₀₁₂₃₄₅₆₇₈₉²³⁴", r"\b[^\W\d_]+[₀-₉²³⁴]"), ("_", r"\w*_\w*"), ("0", r"\d[\w.,/]*"),
)


@lru_cache(1024)
def _out(signs: frozenset[str]) -> re.Pattern:
    return re.compile("|".join(p for of, p in _OUTS if any(c in signs for c in of)))


_INVISIBLE = re.compile("[" + "".join(re.escape(c) for c, to in tables()[0].items() if not to) + "]+")
_END = re.compile(r"[.!?…。！？]+[\"”»’)\]]*(?=\s)|[\n\r\u2028\u2029]+")
_MAY_OUT = re.compile(r"[\"“„«/&<@_'’₀-₉²³⁴\d]|(?<=www)\.")


@lru_cache(1)
def _plain() -> dict[int, str]:
    return {ord(k): v for k, v in tables()[0].items()}


_BACK = str.maketrans("aceopxyABCEHKMOPTX", "асеорхуАВСЕНКМОРТХ")


@lru_cache(50_000)
def plain_word(w: str) -> str:
    """Lower-case word in one script, with disguised letters brought back."""
    if not w.isascii():
        w = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", w).translate(_plain()))
        if not w.isascii():
            kinds = {("c" if "Ѐ" <= c <= "ԯ" else "l") for c in w if c.isalpha() and (c.isascii() or "Ѐ" <= c <= "ԯ")}
            if len(kinds) == 2 or not kinds:
                t = w.translate(_looks())
                w = t if not regex.search(r"\p{Cyrillic}", t) else w.translate(_BACK)
    return w.lower()


@lru_cache(1)
def _looks() -> dict[int, str]:
    return {ord(a): b for a, b in look_alikes().items()}


class Lattices:
    """All segmentations of many words into pieces: edges (word, from, to, piece) in order of their end and of their start.

    pieces: numbers of pieces. A single character is always a piece: without a number it gets a new one if ``grow``,
    else the number ``odd``. grow: pieces of ``vocab`` get numbers as they are met."""

    def __init__(self, words: list[str], pieces: dict[str, int], vocab=frozenset(), grow: bool = False, odd: int = 0):
        ws: list[int] = []
        fs: list[int] = []
        ts: list[int] = []
        ps: list[int] = []
        for r, word in enumerate(words):
            t = "▁" + word
            n = len(t)
            for i in range(n):
                for j in range(i + 1, min(n, i + LONGEST) + 1):
                    p = t[i:j]
                    at = pieces.get(p)
                    if at is None:
                        if grow and (j == i + 1 or p in vocab):
                            at = pieces[p] = len(pieces)
                        elif j == i + 1:
                            at = odd
                        else:
                            continue
                    ws.append(r), fs.append(i), ts.append(j), ps.append(at)
        self.w, self.f, self.t, self.p = (np.array(x, np.int64) for x in (ws, fs, ts, ps))
        self.last = np.array([len(x) + 1 for x in words], np.int64)
        self.n, self.width = len(words), int(self.last.max(initial=0)) + 1
        self.by_end, self.by_start = self._groups(self.t), self._groups(self.f)

    def _groups(self, at: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per place its edges in order of the word, where each word's edges begin among them, and those words."""
        o = np.lexsort((self.w, at))
        out = []
        for place, e in zip(*_runs(at[o], o)):
            first = np.flatnonzero(np.diff(self.w[e], prepend=-1))
            out.append((int(place), e, first, self.w[e][first]))
        return out

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """Sums over all segmentations up to each place; ``prob`` has a row per piece and a column per language."""
        f = np.zeros((self.n, self.width, prob.shape[1]))
        f[:, 0] = 1.0
        for place, e, first, words in self.by_end:
            f[words, place] = np.add.reduceat(f[self.w[e], self.f[e]] * prob[self.p[e]], first)
        return f

    def backward(self, prob: np.ndarray) -> np.ndarray:
        b = np.zeros((self.n, self.width, prob.shape[1]))
        b[np.arange(self.n), self.last] = 1.0
        for place, e, first, words in reversed(self.by_start):
            b[words, place] = np.add.reduceat(b[self.w[e], self.t[e]] * prob[self.p[e]], first)
        return b


def _runs(sorted_keys: np.ndarray, values: np.ndarray):
    """(different keys, the values of each)."""
    if not len(sorted_keys):
        return [], []
    cut = np.flatnonzero(np.diff(sorted_keys)) + 1
    return sorted_keys[np.concatenate([[0], cut])], np.split(values, cut)


def _passes(words: list[str]) -> list[list[str]]:
    """Words in passes of like length and bounded size."""
    out: list[list[str]] = []
    room = 0
    for w in sorted(words, key=lambda x: (len(x), x)):
        if not out or room < len(w) + 2:
            out.append([])
            room = PASS * 16
        out[-1].append(w)
        room -= len(w) + 2
    return out


class _Fit:
    """Lattices of counted words, with pieces numbered across all languages."""

    def __init__(self, counts: Counter[str], pieces: dict[str, int], vocab):
        self.lats = [(Lattices(ws, pieces, vocab, grow=True), np.array([counts[w] for w in ws], float)) for ws in _passes(list(counts))]

    def expectation(self, lengths: np.ndarray, start: np.ndarray | None, rounds: int) -> np.ndarray:
        """Piece probabilities by expectation maximisation, summing over all segmentations; without ``start`` all begin alike."""
        n = len(lengths)
        if start is None:
            start = sum((np.bincount(x.p, minlength=n) for x, _ in self.lats), np.zeros(n))
            start = start / max(1.0, start.sum())
        prob, scale = start, LETTER**lengths
        for _ in range(rounds):
            p = (np.maximum(prob, 1e-9) * scale)[:, None]
            got = np.zeros(n)
            for x, c in self.lats:
                f, b = x.forward(p)[:, :, 0], x.backward(p)[:, :, 0]
                whole = f[np.arange(x.n), x.last]
                ok = np.isfinite(whole) & (whole > 0)
                share = np.where(ok, c, 0) / np.where(ok, whole, 1)
                got += np.bincount(x.p, share[x.w] * f[x.w, x.f] * p[x.p, 0] * b[x.w, x.t], minlength=n)
            prob = got / (got.sum() or 1.0)
            prob[prob <= 1e-9] = 0.0
        return prob

    def mixture(self, lengths: np.ndarray, start: np.ndarray | None) -> np.ndarray:
        return (1 - SPREAD) * self.expectation(lengths, start, ROUNDS) + SPREAD * self.expectation(lengths, None, 1)


class LanguageModel:
    """Piece probabilities of each language, a row of ``probs`` per piece, and the words they were fitted on."""

    def __init__(self, langs: list[str], pieces: list[str], probs: np.ndarray, words: frozenset[str]):
        self.langs, self.words, self.pieces = langs, words, pieces
        self.piece = {p: i for i, p in enumerate(pieces)}
        # a piece of several letters that no sample has would drown the evidence of its parts, so only letters have a floor
        self.plain = np.vstack([probs.reshape(len(pieces), len(langs)), np.full((1, len(langs)), 1e-7)])
        self.probs = self.plain * LETTER ** np.array([len(p) for p in pieces] + [1.0])[:, None]
        self.letters = frozenset("".join(words))
        self._forget()

    def _forget(self) -> None:
        """Row 0 of the table is a word that says nothing."""
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs) + 2))
        self.rows = 1

    @classmethod
    def fit(cls, counts: dict[str, Counter[str]], path: str = VOCABULARY) -> LanguageModel:
        vocab = vocabulary(path)
        langs = sorted(counts)
        pieces: dict[str, int] = {}
        base = _Fit(sum(counts.values(), Counter()), pieces, vocab)
        own = [_Fit(counts[x], pieces, vocab) for x in langs]
        lengths = np.array([len(p) for p in pieces], float)
        common = base.mixture(lengths, None)
        probs = np.array([(1 - COMMON) * x.mixture(lengths, common) + COMMON * common for x in own]).reshape(len(langs), len(pieces)).T
        used = np.flatnonzero(probs.any(1))
        names = list(pieces)
        return cls(langs, [names[i] for i in used], probs[used], frozenset(w for c in counts.values() for w in c))

    def state(self) -> tuple:
        return self.langs, self.pieces, self.plain[:-1], self.words

    def score(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language, less that of the best and at least ``-WORD_MOST``."""
        out = np.zeros((len(words), len(self.langs)))
        at = {w: i for i, w in enumerate(words)}
        for ws in _passes([w for w in at if len(w) <= SHORT]):
            x = Lattices(ws, self.piece, odd=len(self.pieces))
            out[[at[w] for w in ws]] = x.forward(self.probs)[np.arange(x.n), x.last]
        for w in at:
            if len(w) > SHORT:
                out[at[w]] = self._long(w)
        with np.errstate(divide="ignore"):
            got = np.log(np.maximum(out, 1e-300))
        return np.maximum(got - got.max(1, keepdims=True), -WORD_MOST) if len(self.langs) else out

    def _long(self, word: str) -> np.ndarray:
        """The sums over all segmentations of a word of any length, up to a common factor."""
        t = "▁" + word
        window = [np.ones(len(self.langs))]
        for j in range(1, len(t) + 1):
            x = np.zeros(len(self.langs))
            for k in range(1, min(j, LONGEST) + 1):
                at = self.piece.get(t[j - k : j], len(self.pieces) if k == 1 else None)
                if at is not None:
                    x += window[-k] * self.probs[at]
            window = [*window[1 - LONGEST :], x]
            top = max(y.max() for y in window)
            if not 1e-100 < top < 1e100:
                window = [y / max(top, 1e-300) for y in window]
        return window[-1] / (window[-1].max() or 1.0)

    def numbers(self, raw: list[str]) -> np.ndarray:
        """The row of ``table`` for each word as written: scores, 1 if it says anything, 1 if a sample has it."""
        known = self.known
        new = [w for w in set(raw) if w not in known]
        if len(new) + self.rows > CACHE and self.rows > 1:
            self._forget()
            known, new = self.known, list(set(raw))
        if new:
            plain = {w: plain_word(w) for w in sorted(new)}
            says = sorted({p for p in plain.values() if p and self.letters.issuperset(p)})
            row = dict(zip(says, range(self.rows, self.rows + len(says))))
            need = self.rows + len(says)
            if need > len(self.table):
                self.table = np.vstack([self.table, np.zeros((max(need, 2 * len(self.table)) - len(self.table), self.table.shape[1]))])
            if says:
                t = self.table[self.rows : need]
                sure = np.array([p in self.words for p in says], float)
                t[:, :-2], t[:, -2], t[:, -1] = self.score(says) * np.where(sure > 0, 1.0, UNSURE)[:, None], 1.0, sure
            self.rows = need
            known.update((w, row.get(p, 0)) for w, p in plain.items())
        return np.array([known[w] for w in raw], np.int64)


def bare(text: str) -> str:
    """A text without quoted words, addresses, sound scripts, numbers and invisible characters."""
    if signs := _MAY_OUT.findall(text):
        text = _out(frozenset("0" if c.isdecimal() else c for c in signs)).sub(" _ ", text)
    return text if text.isascii() else _INVISIBLE.sub("", text)


def raw_words(text: str) -> list[str]:
    """The words of ``bare`` text as written."""
    b = bare(text)
    return (_LETTERS if b.isascii() else _WORD).findall(b)


def plain_words(text: str) -> list[str]:
    return [w for w in map(plain_word, raw_words(text)) if w]


def sentences(text: str) -> list[tuple[int, str]]:
    """(start, sentence or line) in order; start counts the characters of ``text``."""
    out, at = [], 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        part = text[at:end]
        if s := part.strip():
            out.append((at + len(part) - len(part.lstrip()), s))
        at = end
    return out


def _units(texts: list[str | None], model: LanguageModel) -> tuple[np.ndarray, list[int], np.ndarray]:
    """The sentences and lines that count: the text of each, its start, and its summed scores, words and known words."""
    owner: list[int] = []
    start: list[int] = []
    words: list[str] = []
    first: list[int] = []
    for d, text in enumerate(texts):
        if not text:
            continue
        for at, s in sentences(text):
            ws = raw_words(s)
            if ws:
                owner.append(d), start.append(at), first.append(len(words))
                words += ws
    if not owner:
        return np.zeros(0, np.int64), [], np.zeros((0, len(model.langs) + 2))
    numbers = model.numbers(words)
    total = np.add.reduceat(model.table[numbers], first)
    own, n, known = np.array(owner), total[:, -2], total[:, -1]
    some = np.zeros(len(texts), bool)
    some[own[known > 0]] = True
    all_n = np.bincount(own, n, len(texts))
    # headings and debris: a few words that no sample knows, beside others that one does
    keep = (n > 0) & ((known > 0) | (n >= FEW_WORDS) | (~some[own] & (all_n[own] >= FEW_WORDS)))
    at = np.flatnonzero(keep)
    total[n < FEW_WORDS, :-2] *= UNSURE
    return own[at], [start[i] for i in at], total[at]


def _path(score: np.ndarray) -> list[int]:
    """The best language of each row, where a change costs ``SWITCH``."""
    best, back = score[0], []
    stay = np.arange(score.shape[1])
    for u in score[1:]:
        top = int(best.argmax())
        move = best[top] - SWITCH > best
        back.append(np.where(move, top, stay))
        best = np.where(move, best[top] - SWITCH, best) + u
    at = int(best.argmax())
    path = [at]
    for b in reversed(back):
        at = int(b[at])
        path.append(at)
    return path[::-1]


def segments_of(texts: list[str | None], model: LanguageModel) -> list[list[tuple[int, str, float]]]:
    """(start, language, confidence) of the segments of each text."""
    out: list[list[tuple[int, str, float]]] = [[] for _ in texts]
    if not model.langs:
        return out
    own, start, total = _units(texts, model)
    score = total[:, :-2]
    for d, rows in zip(*_runs(own, np.arange(len(own)))):
        u = score[rows]
        whole = u.sum(0)
        x = int(whole.argmax())
        if (u[:, x] >= u.max(1)).all():  # no change can gain
            out[d] = [(0, model.langs[x], float(1.0 / np.exp(whole - whole[x]).sum()))]
            continue
        path = np.array(_path(u))
        cut = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1])
        for k, v in zip(cut, np.add.reduceat(u, cut)):
            x = path[k]
            out[d].append((start[rows[k]] if k else 0, model.langs[x], float(1.0 / np.exp(v - v[x]).sum())))
    return out


def segments(text: str | None, model: LanguageModel) -> list[tuple[int, str, float]]:
    return segments_of([text], model)[0]


def fitted(samples: list[tuple[str, str]], labelled: list[tuple[str, str]], path: str = VOCABULARY) -> LanguageModel:
    """The model of labelled sample sentences, then of these and the documents whose label a fit so far confirms."""
    counts: dict[str, Counter[str]] = defaultdict(Counter)
    for lang, text in samples:
        counts[lang].update(plain_words(text))
    model = LanguageModel.fit(counts, path)
    texts = [x for _, x in labelled]
    for _ in range(2 if labelled and counts else 0):
        more = {k: Counter(c) for k, c in counts.items()}
        for (code, text), got in zip(labelled, segments_of(texts, model)):
            if len(got) == 1 and got[0][1] == code and got[0][2] > 0.999:
                for _, s in sentences(text):
                    ws = plain_words(s)
                    if len(ws) >= FEW_WORDS and 4 * sum(w in model.words for w in ws) >= 3 * len(ws):
                        more[code].update(ws)
        model = LanguageModel.fit(more, path)
    return model


def labelled_sample(docs: DataFrame, langs: list[str], label: str = "lang", text: str = "text", seed: int = 7) -> list[tuple[str, str]]:
    """(code, text) of at most ``MOST_DOCUMENTS`` different texts per language their label names, those of least hash.

    Hashes are cut off where about twice as many different texts are left before these are ranked."""
    d = docs.select(code_column(F.col(label), langs).alias("code"), F.col(text).alias("text")).filter(F.col("code").isNotNull() & F.length("text").between(1, MOST_CHARS))
    many = {r["code"]: r["n"] for r in d.groupBy("code").agg(F.approx_count_distinct("text").alias("n")).collect()}  # a row per language
    d = d.withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1_000_000)))
    take = [(F.col("code") == k) & (F.col("h") < int(1_000_000 * min(1.0, 2.0 * MOST_DOCUMENTS / max(1, n)))) for k, n in many.items()]
    if not take:
        return []
    cond = take[0]
    for t in take[1:]:
        cond = cond | t
    few = d.filter(cond).dropDuplicates(["code", "text"]).withColumn("_n", F.row_number().over(W.partitionBy("code").orderBy("h", "text"))).filter(F.col("_n") <= MOST_DOCUMENTS)
    return sorted((r["code"], r["text"]) for r in few.select("code", "text").collect())


_MODELS: dict[int, LanguageModel] = {}


def language_segments(docs: DataFrame, samples: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, label, code, seg_start, lang, confidence, n_segments) of every segment of (doc_id, lang, text); code is
    the language of ``samples`` that the document's label names, if any."""
    w = W.partitionBy("lang").orderBy("sample_id", "text")
    few = samples.filter(F.col("lang").isNotNull()).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= MOST_SAMPLES)
    fit = sorted((r["lang"], r["text"] or "") for r in few.select("lang", "text").collect())
    langs = sorted({x for x, _ in fit})
    state = fitted(fit, labelled_sample(docs, langs), path).state()
    name = uuid.uuid4().int

    def run(batches):
        model = _MODELS.get(name)
        if model is None:
            _MODELS.clear()
            model = _MODELS[name] = LanguageModel(*state)
        for b in batches:
            for a in range(0, b.num_rows, TEXTS):
                part = b.slice(a, TEXTS)
                got = segments_of(part.column(2).to_pylist(), model)
                n = [len(x) for x in got]
                flat = [y for x in got for y in x]
                at = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array([y[0] for y in flat], pa.int32()), pa.array([y[1] for y in flat], pa.string()),
                     pa.array([y[2] for y in flat], pa.float64()), pa.array(np.repeat(n, n), pa.int32())],
                    names=["doc_id", "label", "seg_start", "lang", "confidence", "n_segments"],
                )

    s = docs.select(F.col("doc_id").cast("bigint"), F.col("lang").alias("label"), "text").mapInArrow(
        run, "doc_id BIGINT, label STRING, seg_start INT, lang STRING, confidence DOUBLE, n_segments INT"
    )
    return s.select("doc_id", "label", code_column(F.col("label"), langs).alias("code"), "seg_start", "lang", "confidence", "n_segments")


def code_column(label: Column, langs: list[str]) -> Column:
    """``label_code`` as a column expression."""
    low = F.lower(F.trim(label))
    base = F.regexp_extract(low, "^[^-_ .@]*", 0)
    null = F.lit(None).cast("string")
    of = {k: [k.lower(), *SPELLINGS.get(k.lower(), "").split()] for k in langs}
    return F.coalesce(*[F.when(x.isin(v), F.lit(k)) for x in (low, base) for k, v in of.items()], null)


def is_case(code: Column, lang: Column, n: Column) -> Column:
    """Whether a segment belongs to a document whose label is missing, names no language or another, or that is mixed."""
    return (n > 1) | code.isNull() | (code != lang)


def mislabelled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p8_found``: the segments of documents without a right label or in several languages."""
    s = language_segments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))
    return s.filter(is_case(F.col("code"), F.col("lang"), F.col("n_segments"))).select("doc_id", "seg_start", "lang")

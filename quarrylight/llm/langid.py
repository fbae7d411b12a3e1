"""Language ID by unigrams over a fixed vocabulary, summed over all segmentations of each word."""

from __future__ import annotations

import copy
import functools
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.store import saved

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Runs of word characters without digits and underscores.
WORD = re.compile(r"[^\W\d_]+")
START = "▁"
UNKNOWN = "und"
#: About so many labelled rows at most, those of least hash, fit the model, with all their words.
FIT_ROWS = 20_000
BASE = np.uint64(1_000_003)
SLOTS = 20
CACHE_WORDS = 400_000


@functools.cache
def pieces(path: str = VOCABULARY) -> tuple[str, ...]:
    """The vocabulary's lower-case pieces of letters, with or without the word start."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(k) for k in range(model.get_piece_size()))
    return tuple(sorted({p for p in found if (p.lstrip(START).isalpha() and p.count(START) <= 1 or p == START) and p == p.lower()}))


#: Characters of the longest piece, with the word start.
MAX_PIECE = max(map(len, pieces()))


def _hash(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of rows of code points, with a zero before."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * BASE + codes[:, k]
    return out


def _codes(words: list[str], width: int) -> np.ndarray:
    padded = "".join(w.ljust(width, "\0") for w in words)
    return np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), width).astype(np.uint64) + np.uint64(1)


class Segmenter:
    """Finds the vocabulary's pieces in many words at once, by hash."""

    def __init__(self, vocabulary: tuple[str, ...]):
        self.size = len(vocabulary)
        keys = np.zeros(self.size, np.uint64)
        for n in range(1, MAX_PIECE + 1):
            of = [k for k, p in enumerate(vocabulary) if len(p) == n]
            if of:
                keys[of] = _hash(_codes([vocabulary[k] for k in of], n))[:, n]
        self.tables = []
        left = np.arange(self.size)
        for multiplier in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93):
            table, m = np.full(1 << SLOTS, self.size), np.uint64(multiplier)
            table[(keys[left] * m) >> np.uint64(64 - SLOTS)] = left
            left = left[table[(keys[left] * m) >> np.uint64(64 - SLOTS)] != left]
            self.tables.append((m, table))
            if not len(left):
                break
        self.keys = np.append(keys, np.uint64(0))
        self.power = [np.uint64(pow(int(BASE), n, 1 << 64)) for n in range(MAX_PIECE + 1)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes; ``size`` where there is none."""
        out = np.full(keys.shape, self.size)
        for m, table in self.tables:
            at = table[(keys * m) >> np.uint64(64 - SLOTS)]
            out = np.where(self.keys[at] == keys, at, out)
        return out

    def lattice(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """(end, length) -> the piece at that place of each word; all words have one length."""
        width = len(words[0]) + 1
        hashes = _hash(_codes([START + w for w in words], width))
        return {(e, n): self.find(hashes[:, e] - hashes[:, e - n] * self.power[n]) for e in range(1, width + 1) for n in range(1, min(e, MAX_PIECE) + 1)}


class Model:
    """Log probabilities of pieces per language, and priors."""

    def __init__(self, languages: list[str], vocabulary: tuple[str, ...], weights: np.ndarray, priors: np.ndarray):
        self.languages, self.vocabulary, self.priors = languages, vocabulary, priors
        self.segmenter = Segmenter(vocabulary)
        self.set_weights(weights)

    def set_weights(self, weights: np.ndarray) -> None:
        smooth = weights + 0.05
        p = smooth / smooth.sum(axis=0)
        self.p = np.vstack([p, np.zeros(len(self.languages))])
        self.stray = p.min(axis=0) * 0.01  # a character outside the vocabulary

    def _step(self, lattice: dict, e: int, n: int) -> np.ndarray:
        found = lattice[e, n]
        p = self.p[found]
        if n == 1:
            p = np.where((found == self.segmenter.size)[:, None], self.stray, p)
        return p

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of each word under each language, summed over all its segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for length, rows in by_length.items():
            step = max(1, min(50_000, 2_000_000 // (length + 1)))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                out[part] = self._forward([words[k] for k in part], length) if length <= 64 else self._long([words[k] for k in part], length)
        return out

    def _forward(self, words: list[str], length: int) -> np.ndarray:
        lattice = self.segmenter.lattice(words)
        alpha = [np.ones((len(words), len(self.languages)))]
        scale = np.zeros(len(words))
        for e in range(1, length + 2):
            new = sum(alpha[e - n] * self._step(lattice, e, n) for n in range(1, min(e, MAX_PIECE) + 1))
            alpha.append(new)
            if e % 8 == 0:  # keep the numbers within range
                top = new.max(axis=1, keepdims=True)
                for k in range(max(0, e - MAX_PIECE), e + 1):
                    alpha[k] = alpha[k] / top
                scale += np.log(top[:, 0])
        return np.log(np.maximum(alpha[-1], 1e-300)) + scale[:, None]

    def _long(self, words: list[str], length: int) -> np.ndarray:
        """The same for long words, which are rare: a window of the last positions only."""
        out = np.zeros((len(words), len(self.languages)))
        for k, word in enumerate(words):
            hashes = _hash(_codes([START + word], length + 1))[0]
            alpha, scale = [np.ones(len(self.languages))], 0.0
            found = [self.segmenter.find(hashes[n:] - hashes[: len(hashes) - n] * self.segmenter.power[n]) for n in range(1, min(length + 1, MAX_PIECE) + 1)]
            for e in range(1, length + 2):
                new = alpha[-1] * (self.p[found[0][e - 1]] if found[0][e - 1] < self.segmenter.size else self.stray)
                for n in range(2, min(e, MAX_PIECE) + 1):
                    new = new + alpha[-n] * self.p[found[n - 1][e - n]]
                alpha = [*alpha[-MAX_PIECE:], new]
                if e % 8 == 0:
                    top = new.max()
                    alpha = [a / top for a in alpha]
                    scale += np.log(top)
            out[k] = np.log(np.maximum(alpha[-1], 1e-300)) + scale
        return out

    def only(self, lang: str) -> Model:
        """The model of one language."""
        k = self.languages.index(lang)
        one = copy.copy(self)
        one.languages, one.p, one.stray = [lang], self.p[:, k : k + 1], self.stray[k : k + 1]
        return one

    def expect(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected piece counts (forward and backward) of counted words, of a model of one language."""
        total = np.zeros(self.segmenter.size + 1)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) <= 40:
                by_length.setdefault(len(w), []).append(k)
            else:
                self._expect_long(w, counts[k], total)
        for length, rows in by_length.items():
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                lattice = self.segmenter.lattice([words[k] for k in part])
                steps = {place: self._step(lattice, *place)[:, 0] for place in lattice}
                ones = np.ones(len(part))
                alpha, beta = [ones], {length + 1: ones}
                for e in range(1, length + 2):
                    alpha.append(sum(alpha[e - n] * steps[e, n] for n in range(1, min(e, MAX_PIECE) + 1)))
                for s in range(length, -1, -1):
                    beta[s] = sum(beta[s + n] * steps[s + n, n] for n in range(1, min(length + 1 - s, MAX_PIECE) + 1))
                weight = counts[part] / np.maximum(alpha[-1], 1e-300)
                for (e, n), found in lattice.items():
                    total += np.bincount(found, alpha[e - n] * steps[e, n] * beta[e] * weight, self.segmenter.size + 1)
        return total[:-1]

    def _expect_long(self, word: str, count: float, total: np.ndarray) -> None:
        """The same for one long word, by logarithms."""
        length = len(word) + 1
        hashes = _hash(_codes([START + word], length))[0]
        logs = np.log(np.append(self.p[:-1, 0], 1e-300))
        found = {n: self.segmenter.find(hashes[n:] - hashes[:-n] * self.segmenter.power[n]) for n in range(1, MAX_PIECE + 1)}
        steps = {n: logs[f] for n, f in found.items()}
        steps[1] = np.where(found[1] == self.segmenter.size, np.log(self.stray[0]), steps[1])
        ahead, behind = np.full(length + 1, -np.inf), np.full(length + 1, -np.inf)
        ahead[0] = behind[length] = 0
        for e in range(1, length + 1):
            ahead[e] = np.logaddexp.reduce([ahead[e - n] + steps[n][e - n] for n in range(1, min(e, MAX_PIECE) + 1)])
        for s in range(length - 1, -1, -1):
            behind[s] = np.logaddexp.reduce([behind[s + n] + steps[n][s] for n in range(1, min(length - s, MAX_PIECE) + 1)])
        for n, f in found.items():
            total += np.bincount(f, count * np.exp(ahead[:-n] + steps[n] + behind[n:] - ahead[length]), self.segmenter.size + 1)


def _piece_counts(counted: DataFrame, run: Callable[[str, list[str], np.ndarray], np.ndarray], languages: list[str]) -> np.ndarray:
    """Pieces x languages: what ``run`` finds in each language's counted words, summed by Spark.

    No more than a number for each piece of the vocabulary and language comes to the driver.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, words, n = (np.array(batch.column(k).to_pylist(), object) for k in range(3))
            for lang in set(langs):
                of = langs == lang
                found = run(lang, list(words[of]), n[of].astype(float))
                totals[lang] = totals[lang] + found if lang in totals else found
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "piece", "w"])

    found = counted.select("lang", "word", "n").mapInArrow(part, "lang string, piece int, w double").groupBy("lang", "piece").agg(F.sum("w").alias("w")).toPandas()
    out = np.zeros((len(pieces()), len(languages)))
    out[found["piece"], found["lang"].map({lang: k for k, lang in enumerate(languages)})] = found["w"]
    return out


def _own_pieces(lang: str, words: list[str], n: np.ndarray) -> np.ndarray:
    """Counts of the pieces of the vocabulary's own segmentation."""
    number, total = {p: k for k, p in enumerate(pieces())}, np.zeros(len(pieces()))
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    for found, count in zip(model.encode(words, out_type=str, num_threads=1), n, strict=True):
        for piece in found:
            if piece in number:
                total[number[piece]] += count
    return total


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, rounds: int = 2) -> Model | None:
    """Learn from rows with text and a label that the fold lets; None if there are none.

    The rows of least id hash are taken, about ``rows`` at most, with all their words. The label
    ``und`` says that a language isn't known, so it isn't learned. Piece probabilities start from
    the vocabulary's own segmentation of these words and are refined by expectation-maximisation;
    Spark sums the expected counts, and the driver gets one number for each piece and language.
    """
    fold = F.crc32(F.col(id_col).cast("string")) % 3
    usable = F.col(lang_col).isNotNull() & (F.col(lang_col) != UNKNOWN) & F.col(text_col).isNotNull() & (fold != 1)
    labelled = docs.where(usable).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    total = labelled.select("id").count()
    if total > rows:  # a bound on the hash that lets about ``rows`` rows through
        share = rows / total
        labelled = labelled.where(F.xxhash64("id") < F.lit(int(-(2**63) + share * 2**64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[lang] += 1
                words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            rows_out = [(lang, w, n) for lang, c in words.items() for w, n in c.items()] + [(lang, "", n) for lang, n in seen.items()]
            for at in range(0, len(rows_out), 100_000):
                part = list(zip(*rows_out[at : at + 100_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1]), pa.array(part[2], pa.int64())], ["lang", "word", "n"])

    counted = labelled.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = saved(counted, "words")
    seen = {r.lang: r.n for r in counted.where("word = ''").select("lang", "n").collect()}  # a row a language
    counted = counted.where("word <> ''")
    if not seen or counted.isEmpty():
        return None
    languages = sorted(seen)
    priors = np.log(np.array([seen[lang] for lang in languages]) / sum(seen.values()))
    fitted = Model(languages, pieces(), _piece_counts(counted, _own_pieces, languages), priors)
    for _ in range(rounds):
        held = docs.sparkSession.sparkContext.broadcast(fitted)
        step = lambda lang, words, n: held.value.only(lang).expect(words, n)  # noqa: B023, E731
        weights = _piece_counts(counted, step, languages)
        fitted = Model(languages, pieces(), weights, priors)
        held.destroy()
    return fitted


class Scorer:
    """Scores texts; words' log probabilities are kept up to a bound."""

    def __init__(self, model: Model):
        self.model, self.known, self.table = model, {}, np.zeros((0, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.table, new = {}, self.table[:0], list(words)
        if new:
            at = len(self.known)
            self.known.update((w, at + k) for k, w in enumerate(new))
            self.table = np.concatenate((self.table, self.model.forward(new)))

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found = [WORD.findall((t or "").lower()) for t in texts]
        self.learn(set().union(*found) if found else set())
        get, none = self.known.__getitem__, np.zeros(len(self.model.languages))
        langs, scores = [], np.zeros(len(texts))
        for k, words in enumerate(found):
            if not any(c.isalpha() for w in words for c in w):
                langs.append(UNKNOWN)
                continue
            logs = self.model.priors + (self.table[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0) if words else none)
            best = int(np.argmax(logs))
            langs.append(self.model.languages[best])
            scores[k] = 1 / np.exp(logs - logs[best]).sum()
        return langs, scores


#: The scorer of the last model in this Python worker.
_scorers: dict[str, Scorer] = {}


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """Columns ``carry`` as c0, c1, ..., then held_out, lang_pred and score, one row per row of ``docs``."""
    model = model or fit(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages, whatever the corpus
    key = str(zlib.crc32(model.p.tobytes())) if model else ""
    carry = [id_col] if carry is None else carry
    names = [f"c{k}" for k in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        if fitted and key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(fitted)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(len(names)).to_pylist()
                langs, scores = _scorers[key].score(texts) if fitted else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                kept = [part.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, part.column(len(names) + 1), pa.array(langs, pa.string()), pa.array(scores)], [*names, "held_out", "lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], F.col(text_col).alias("text"), held.alias("held_out"))
    types = [docs.schema[c].dataType.simpleString() for c in carry]
    return rows.mapInArrow(run, ", ".join([*(f"{n} {t}" for n, t in zip(names, types, strict=True)), "held_out boolean, lang_pred string, score double"]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """Per row: id_col, held_out, lang_pred, score.

    The model is fitted by ``fit`` unless one is given. Texts are scored whole: lower-cased, each
    word's probability is the sum over all its segmentations into vocabulary pieces, and the
    posterior of the best language is the score. ``und`` with score 0 for null texts, texts without
    a letter, and where there is nothing to learn from. held_out: crc32 of the id as text leaves 1
    when divided by 3; false for a null id, which is not learned from either. Repeated rows each
    get their row, an empty table gives none; other columns are ignored.
    """
    return with_language(docs, id_col, text_col, lang_col, [id_col], model).withColumnRenamed("c0", id_col)


def in_known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, but those without a language or of a posterior under ``least``."""
    kept = with_language(docs, id_col, text_col, lang_col, docs.columns).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])

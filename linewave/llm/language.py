"""Language identification by segmentation-marginalised unigrams (operator 5).

The pieces of a fixed public vocabulary have a probability in each language. A word's probability is the
sum over all its segmentations into pieces, found by a forward algorithm; a text's is the product over its
words. The piece probabilities are fitted by expectation-maximisation: a forward-backward pass gives each
piece's expected count over all segmentations of the training words.

A word is a mark and a run of letters (Unicode category L) of any length, lower-cased; white space, digits, number
signs and other signs say nothing. In long words the rows of the forward and backward pass are scaled on their way, since a
product over many letters is below what a double holds; they are worked in stretches, so memory does not grow with them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewave.llm.common import held_out, slices
from linewave.storage import written

MARK = "▁"
#: Words of up to so many characters go through without scaling.
SHORT = 24
#: Positions of a long word that are looked up at a time, and steps between two scalings.
STRETCH, EVERY = 1 << 14, 8
#: Bytes of forward rows held at a time, and of a scorer's cache.
ROWS_BYTES, CACHE_BYTES = 16 << 20, 48 << 20
#: Probability of a letter that is no piece, the same in every language.
UNKNOWN = 1e-7
_LETTERS = regex.compile(r"\p{L}+")
_vocabularies: dict[str, "Pieces"] = {}

#: Base of the hash that substrings of a word are looked up by.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    table = _tables.get(base)
    if table is None:
        table = np.ones(1, dtype=np.uint64)
    while len(table) < n:
        table = np.concatenate([table, table * np.uint64(pow(base, len(table), 1 << 64))])
    _tables[base] = table
    return table[:n]


class Pieces:
    """The vocabulary's lower-case letter pieces, looked up by a rolling hash of their code points."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        self.names = sorted({p for p in every if p == p.lower() and _LETTERS.fullmatch(p.removeprefix(MARK) or "a")})
        self.size = len(self.names)  # id size: no such piece; size + 1: an unknown letter
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(self.names):
            by_length.setdefault(len(p), []).append(i)
        for n, ids in by_length.items():
            points = np.frombuffer("".join(self.names[i] for i in ids).encode("utf-32-le"), dtype="<u4").reshape(-1, n)
            value = ((points.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)).sum(axis=1, dtype=np.uint64)
            order = np.argsort(value)
            self.tables[n] = (value[order], np.asarray(ids)[order])
        self.lengths = np.array(sorted({1, *self.tables}))
        self.longest = int(self.lengths[-1])

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Start and length of each word, and for each piece length the piece that begins at each point."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        total = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum((points + np.uint64(1)) * _powers(_BASE, len(points)), out=total[1:])
        back = _powers(_INVERSE, len(points))
        left = np.repeat(starts + lengths, lengths) - np.arange(len(points))  # points up to the word's end
        found = {}
        for n, (values, ids) in self.tables.items():
            at = np.flatnonzero(left >= n)
            if len(at) and len(values):
                key = (total[at + n] - total[at]) * back[at]
                place = np.minimum(np.searchsorted(values, key), len(values) - 1)
                own = np.full(len(points), self.size, dtype=np.int64)
                own[at] = np.where(values[place] == key, ids[place], self.size)
                if n == 1:
                    own[own == self.size] = self.size + 1
                found[n] = own
        return starts, lengths, found

    def ending(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start of each word, and for each point the pieces of every length that end before it."""
        starts, _, found = self.lattice(words)
        total = sum(map(len, words))
        out = np.full((total + 1, len(self.lengths)), self.size, dtype=np.int64)
        for j, n in enumerate(self.lengths):
            if n in found:
                out[n:, j] = found[n][: total + 1 - n]
        return starts, out

    def forward(self, words: list[str], chance: np.ndarray) -> np.ndarray:
        """(words, languages) log probabilities under ``chance`` (size + 2, languages)."""
        out = np.zeros((len(words), chance.shape[1]))
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        n_long = sum(len(w) > SHORT for w in words)
        each = max(1, ROWS_BYTES // (8 * (SHORT + 1) * chance.shape[1]))
        for lo in range(n_long, len(words), each):
            at = order[lo : lo + each]
            out[at] = self._short(words=[words[i] for i in at], chance=chance)
        each = max(1, ROWS_BYTES // (8 * 2 * self.longest * chance.shape[1]))
        for lo in range(0, n_long, each):
            at = order[lo : min(lo + each, n_long)]
            out[at] = self._long(words=[words[i] for i in at], chance=chance)
        return out

    def _short(self, words: list[str], chance: np.ndarray) -> np.ndarray:
        """:meth:`forward` of words that need no scaling, the longest first."""
        starts, lengths, found = self.lattice(words)
        alpha = np.zeros((lengths[0] + 1, len(words), chance.shape[1]))
        alpha[0] = 1
        for end in range(1, lengths[0] + 1):
            live = np.searchsorted(-lengths, -end, side="right")  # the longest words come first
            for n, piece in found.items():
                if n <= end:
                    alpha[end, :live] += alpha[end - n, :live] * chance[piece[starts[:live] + end - n]]
        return np.log(alpha[lengths, np.arange(len(words))])

    def _long(self, words: list[str], chance: np.ndarray) -> np.ndarray:
        """:meth:`forward` of words of any length, the longest first, with the last rows scaled every few steps."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        rows = np.zeros((self.longest, len(words), chance.shape[1]))  # of the last positions, in turn
        rows[0] = 1
        scale = np.zeros(rows.shape[1:])
        out = np.empty(rows.shape[1:])
        stretch = max(self.longest, STRETCH // len(words))
        for lo in range(0, sizes[0], stretch):
            lead = min(lo, self.longest)
            live = np.searchsorted(-sizes, -lo, side="left")
            starts, ending = self.ending([w[lo - lead : lo + stretch] for w in words[:live]])
            for end in range(lo + 1, min(lo + stretch, sizes[0]) + 1):
                live = np.searchsorted(-sizes, -end, side="right")
                step = chance[ending[starts[:live] + end - lo + lead]]
                now = np.einsum("nwl,wnl->wl", rows[(end - self.lengths) % self.longest, :live], step)
                rows[end % self.longest, :live] = now
                done = np.searchsorted(-sizes, -end, side="left")
                out[done:live] = np.log(now[done:]) + scale[done:live]
                if end % EVERY == 0:
                    rows[:, :live] /= now
                    scale[:live] += np.log(now)
        return out

    def expected(self, words: list[str], weight: np.ndarray, language: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """(size + 2, languages) expected piece counts over all segmentations of weighted words."""
        return self.expectations(words, weight, language, chance)[1]

    def expectations(self, words: list[str], weight: np.ndarray, language: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word in its language, and (size + 2, languages) expected piece counts of weighted words."""
        order = np.array(sorted(range(len(words)), key=lambda i: -len(words[i])), dtype=np.int64)
        n_long = sum(len(w) > SHORT for w in words)
        log, counts = np.zeros(len(words)), np.zeros(chance.T.size)
        at = order[n_long:]
        if len(at):
            log[at], more = self._short_expected([words[i] for i in at], weight[at], language[at], chance)
            counts += more
        for i in order[:n_long]:
            column = np.ascontiguousarray(chance[:, language[i]])
            log[i], more = self._long_expected(words[i], column)
            counts[language[i] * len(column) : (language[i] + 1) * len(column)] += weight[i] * more
        return log, counts.reshape(chance.shape[1], chance.shape[0]).T

    def _short_expected(self, words: list[str], weight: np.ndarray, language: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`expected` of words that need no scaling, the longest first; counts by language, then piece."""
        starts, lengths, found = self.lattice(words)
        flat = chance.T.ravel()  # language * rows + piece
        rows = chance.shape[0]
        alpha = np.zeros((lengths[0] + 1, len(words)))
        beta = np.zeros((lengths[0] + 1, len(words)))
        alpha[0] = 1
        beta[lengths, np.arange(len(words))] = 1
        for end in range(1, lengths[0] + 1):
            live = np.searchsorted(-lengths, -end, side="right")
            for n, piece in found.items():
                if n <= end:
                    alpha[end, :live] += alpha[end - n, :live] * flat[language[:live] * rows + piece[starts[:live] + end - n]]
        total = alpha[lengths, np.arange(len(words))]
        counts = np.zeros(flat.shape)
        for end in range(lengths[0], 0, -1):
            live = np.searchsorted(-lengths, -end, side="right")
            for n, piece in found.items():
                if n <= end:
                    at = language[:live] * rows + piece[starts[:live] + end - n]
                    step = flat[at] * beta[end, :live]
                    beta[end - n, :live] += step
                    counts += np.bincount(at, weights=weight[:live] * alpha[end - n, :live] * step / total[:live], minlength=len(flat))
        return np.log(total), counts

    def _long_expected(self, word: str, chance: np.ndarray) -> tuple[float, np.ndarray]:
        """Log probability and expected piece counts of one word of any length under one language's ``chance``."""
        n, m = len(word), self.longest
        # Row t stands at t + m; what lies before the word or behind it stays 0. A row is its value times exp of its scale.
        alpha, beta, log_a, log_b = (np.zeros(n + 1 + 2 * m) for _ in range(4))
        alpha[m] = beta[n + m] = 1
        cuts = list(range(0, n, STRETCH))

        def pieces(lo: int) -> np.ndarray:
            lead = min(lo, m)
            _, ending = self.ending([word[lo - lead : lo + STRETCH]])
            return ending[lead + 1 :]  # row i: what ends at position lo + 1 + i

        for lo in cuts:
            step = chance[pieces(lo)]
            for i in range(len(step)):
                t = lo + 1 + i + m
                alpha[t] = step[i] @ alpha[t - self.lengths]
                log_a[t] = log_a[t - 1]
                if i % EVERY == 0:
                    log_a[t - m + 1 : t + 1] += np.log(alpha[t])
                    alpha[t - m + 1 : t + 1] /= alpha[t]
        total = np.log(alpha[n + m]) + log_a[n + m]
        counts = np.zeros(len(chance))
        for lo in reversed(cuts):
            own = pieces(lo)
            step = chance[own]
            for i in range(len(step) - 1, -1, -1):
                t = lo + 1 + i + m  # beta[t] is whole: all pieces that begin at t end later
                if i % EVERY == 0:
                    log_b[t - m : t + 1] = log_b[t] + np.log(beta[t])
                    beta[t - m : t + 1] /= beta[t]
                else:
                    log_b[t - m : t] = log_b[t]
                beta[t - self.lengths] += step[i] * beta[t]
            at = lo + 1 + np.arange(len(step)) + m
            for j, length in enumerate(self.lengths):
                share = alpha[at - length] * step[:, j] * beta[at] * np.exp(log_a[at - length] + log_b[at] - total)
                counts += np.bincount(own[:, j], weights=share, minlength=len(chance))
        return total, counts


def _pieces(path: str) -> Pieces:
    if path not in _vocabularies:
        _vocabularies[path] = Pieces(path)
    return _vocabularies[path]


def words_of(token: str) -> list[str]:
    """The marked words of lower-case text without white space."""
    return [MARK + run for run in _LETTERS.findall(token)]


class Scorer:
    """Log probabilities of texts, with a bounded cache of what stands between white space."""

    def __init__(self, vocabulary: str, chance: np.ndarray, bound: int):
        self.pieces, self.chance, self.bound = _pieces(vocabulary), chance, bound  # bound: bytes of tokens and rows
        self.rows: dict[str, int] = {}
        self.held = 0
        self.table = np.zeros((1024, chance.shape[1] + 1))  # the last column: letter runs

    def _learn(self, tokens: list[str]) -> np.ndarray:
        """Rows for ``tokens``: each sums over the words in it."""
        words = [words_of(t) for t in tokens]
        distinct = sorted({w for own in words for w in own})
        value = np.concatenate([self.pieces.forward(distinct, self.chance), np.zeros((1, self.chance.shape[1]))])
        place = {w: i for i, w in enumerate(distinct)}
        out = np.zeros((len(tokens), self.table.shape[1]))
        flat = np.fromiter((place[w] for own in words for w in own), dtype=np.int64)
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        np.add.at(out[:, :-1], np.repeat(np.arange(len(tokens)), counts), value[flat])
        out[:, -1] = counts
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """(texts, languages + 1): log probabilities and the number of words."""
        split = [(t or "").lower().split() for t in texts]
        wanted = {w for own in split for w in own}
        size = lambda tokens: sum(map(len, tokens)) + len(tokens) * (150 + 8 * self.table.shape[1])
        new = [w for w in wanted if w not in self.rows]
        if self.held and self.held + size(new) > self.bound:
            self.rows, self.table, self.held, new = {}, self.table[:1024], 0, list(wanted)
        self.held += size(new)
        need = len(self.rows) + len(new)
        if need > len(self.table):
            self.table = np.concatenate([self.table[: len(self.rows)], np.zeros((2 * need - len(self.rows), self.table.shape[1]))])
        at = len(self.rows)
        self.table[at:need] = self._learn(new)
        self.rows.update(zip(new, range(at, need)))
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        look = self.rows.__getitem__
        flat = np.fromiter((r for own in split for r in map(look, own)), dtype=np.int64, count=int(counts.sum()))
        out = np.zeros((len(texts), self.table.shape[1]))
        full = np.flatnonzero(counts)
        if len(full):
            out[full] = np.add.reduceat(self.table[flat], (np.cumsum(counts) - counts)[full])
        return out


class LanguageModel:
    """Languages and their piece probabilities; ``predict`` needs texts alone."""

    def __init__(self, vocabulary: str, languages: list[str], chance: np.ndarray, cache: int = CACHE_BYTES):
        self.vocabulary, self.languages, self.chance, self.cache = vocabulary, languages, chance, cache
        self._scorer: Scorer | None = None
        self._judge: Scorer | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_scorer": None, "_judge": None}

    def letters(self) -> np.ndarray:
        """Chances of single letters alone, as often as they stand in all languages' pieces: a model of no language."""
        pieces = _pieces(self.vocabulary)
        often: Counter = Counter()
        for name, n in zip(pieces.names, self.chance[:-2].mean(axis=1)):
            for letter in name:
                often[letter] += n
        total = sum(often.values())
        out = np.array([often[p] / total if len(p) == 1 else 0.0 for p in pieces.names] + [0.0, UNKNOWN])
        return out[:, None]

    def known(self, texts: list[str | None], odds: float = 100.0) -> np.ndarray:
        """Whether each text has letters and is not ``odds`` times likelier as single letters than in its best language."""
        if not self.languages:
            return np.zeros(len(texts), dtype=bool)
        self._judge = self._judge or Scorer(self.vocabulary, np.hstack([self.chance, self.letters()]), self.cache)
        rows = self._judge.score(texts)
        return (rows[:, -1] > 0) & (rows[:, -2] < rows[:, :-2].max(axis=1) + np.log(odds))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability (even prior) of each text; ``und`` and 0 without letters."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        self._scorer = self._scorer or Scorer(self.vocabulary, self.chance, self.cache)
        rows = self._scorer.score(texts)
        log, any_word = rows[:, :-1], rows[:, -1] > 0
        best = log.argmax(axis=1)  # ties: the first by code point
        share = 1 / np.exp(np.minimum(log - log.max(axis=1, keepdims=True), 0)).sum(axis=1)
        return [self.languages[b] if a else "und" for b, a in zip(best, any_word)], np.where(any_word, share, 0.0)


def fit_languages(
    df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs_each: int = 5_000, most_rounds: int = 12, least_gain: float = 1e-3, most_languages: int = 500
) -> LanguageModel:
    """Fit piece probabilities by expectation-maximisation.

    Learns from rows with a language outside the held-out ids: about ``docs_each`` documents of each
    language, chosen by id hash. Word counts and expected piece counts are summed by Spark; the driver gets
    languages x pieces numbers, so more than ``most_languages`` languages are an error. A tenth of the words, by
    hash, is left out of the counts to find the number of rounds: they end when the log likelihood of these words rises by less than
    ``least_gain`` of itself (a round that lowers it is taken back), after ``most_rounds`` at the latest. Then as many rounds go over
    all words, and these give the model. Without such rows the model knows no language.
    """
    spark = df.sparkSession
    usable = df.where(F.col(lang).isNotNull() & ~held_out(F.col(doc_id))).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    languages = sorted(sizes)
    pieces = _pieces(vocabulary)
    if not languages:
        return LanguageModel(vocabulary, [], np.zeros((pieces.size + 2, 0)))
    bound = F.create_map(*(F.lit(v) for s in languages for v in (s, min(1 << 31, -(-docs_each * (1 << 31) // sizes[s])))))
    sample = usable.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 31)) < bound[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            tokens: Counter = Counter()
            for s, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                tokens.update((s, w) for w in (t or "").lower().split())
            words: Counter = Counter()
            for (s, token), n in tokens.items():
                for w in words_of(token):
                    words[s, w] += n
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in words], pa.string()), pa.array([w for _, w in words], pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    words = written(sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("out", F.pmod(F.xxhash64("word"), F.lit(10)) == 0), "words")
    shape = (pieces.size + 2, len(languages))
    even = np.full(shape, 1 / pieces.size)
    even[-2], even[-1] = 0, UNKNOWN
    place = {s: i for i, s in enumerate(languages)}

    def fitted(chance: np.ndarray, all_words: bool) -> tuple[np.ndarray, float]:
        """One round: the new probabilities, and the log likelihood of the words left out under the old ones."""
        now = spark.sparkContext.broadcast(chance)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, log = np.zeros(shape), 0.0
            for batch in batches:
                for lo in range(0, batch.num_rows, 20_000):
                    part = batch.slice(lo, 20_000)
                    own = np.fromiter((place[s] for s in part.column("lang").to_pylist()), dtype=np.int64)
                    n, out = part.column("n").to_numpy().astype(float), part.column("out").to_numpy(zero_copy_only=False)
                    each, counts = _pieces(vocabulary).expectations(part.column("word").to_pylist(), n if all_words else np.where(out, 0.0, n), own, now.value)
                    total, log = total + counts, log + (each * n)[out].sum()
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *piece], pa.int64()), pa.array([-1, *language], pa.int64()), pa.array([log, *total[piece, language]])], names=["piece", "language", "n"])

        # Summed in thousandths as integers, so that the order of tasks cannot change the result.
        sums = words.mapInArrow(expect, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum(F.round(F.col("n") * 1000).cast("long")).alias("n")).toArrow()
        piece, language, n = (sums.column(c).to_numpy() for c in ("piece", "language", "n"))
        counts, own = np.zeros(shape), piece >= 0
        counts[piece[own], language[own]] = n[own] / 1000
        likelihood = n[~own].sum() / 1000
        counts[:-2] += 0.05
        counts[-2:] = 0
        new = counts / counts.sum(axis=0)
        new[-1] = UNKNOWN
        return new, likelihood

    # The words left out say how many rounds to go; then all words are fitted in as many.
    chance, last, rounds = even, None, most_rounds
    for done in range(most_rounds):
        new, likelihood = fitted(chance, False)
        if last is not None and likelihood - last < least_gain * abs(last):
            rounds = done if likelihood > last else done - 1
            break
        chance, last = new, likelihood
    chance = even
    for _ in range(max(1, rounds)):
        chance, _ = fitted(chance, True)
    return LanguageModel(vocabulary, languages, chance)


def identify(df: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``df``.

    A null text or one without a letter is ``und`` with score 0; of languages with the same probability, the first by
    code point is taken. Repeated rows and ids, null ids and extra
    columns are allowed; an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def in_known_language(df: DataFrame, model: LanguageModel, text: str = "text", odds: float = 100.0) -> DataFrame:
    """The rows of ``df``, all columns kept, whose text has letters and is in one of the model's languages.

    A text is in none if it is ``odds`` times likelier as a string of single letters, by their frequency in all languages,
    than in the language that suits it best. Few letters prove little, so short texts stay in doubt. Null and empty
    texts and texts without letters go; without languages all do.
    """
    names = df.columns
    inner = [f"c{i}" for i in range(len(names))]
    at, shared = inner[names.index(text)], df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 1 << 20):
            yield batch.filter(pa.array(shared.value.known(batch.column(at).to_pylist(), odds), pa.bool_()))

    renamed = df.toDF(*inner)
    return renamed.mapInArrow(run, renamed.schema).toDF(*names)

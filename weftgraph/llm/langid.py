"""Language identification by unigrams of pieces, all segmentations of a word summed.

A word is a run of letters, lower-cased, behind the vocabulary's mark of a word's begin. Its probability in a language is the sum over all ways
to cut it into pieces of a fixed public vocabulary of the product of the pieces' probabilities, by the forward algorithm. A letter
that is no piece stands as its bytes, which are pieces. The words of a text are taken as independent, so a text's score in a
language is the sum of its words' logarithms and the language's prior; `score` is the posterior of the best.

Learning is expectation maximisation over the table of distinct (language, word, count): tasks run forward and backward over their
words, expected counts of pieces are summed by Spark, and the driver holds one number a piece and language. Probabilities are smoothed
towards those of all languages together. All learning texts count; nothing is sampled.

Cases: a text that is null or has no letter is `und` with score 0, as is every text if nothing can be learned; an empty table gives no rows; repeated
rows are rows of their own, and learned from as often; ties go to the smaller language; rows with a null doc_id or lang are predicted but not learned
from; very long texts and words are taken whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.runtime import cut

#: Languages at most (more raise); rounds of learning; pieces' weight of the languages' common distribution; words that a task holds.
MAX_LANGS, ROUNDS, SMOOTHING, HELD = 256, 3, 200.0, 200_000
MARK = "▁"
_CELLS = 1 << 17


#: Word characters but digits and the underscore: letters, and numbers of other kinds, which are taken out where a run holds any.
_RUNS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Runs of characters that str.isalpha holds for."""
    runs = _RUNS.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [part for r in runs for part in ([r] if r.isalpha() else "".join(c if c.isalpha() else " " for c in r).split())]


class Pieces:
    """The vocabulary as a trie over symbols: letters that are pieces, then 256 bytes for all others."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        fit = lambda p: p == p.lower() and (p.removeprefix(MARK) == "" or p.removeprefix(MARK).isalpha())
        self.names = sorted({p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if fit(p)})
        self.names += [f"<0x{b:02X}>" for b in range(256)]
        long = [p for p in self.names[:-256] if len(p) > 1]
        inner = sorted({*"".join(long)})
        single = [p for p in self.names[:-256] if len(p) == 1]
        symbols = inner + sorted({*single} - {*inner})
        self.symbol = np.full(0x110000, -1, np.int32)
        self.symbol[[ord(c) for c in symbols]] = np.arange(len(symbols))
        self.bytes_from = len(symbols)
        number = {p: i for i, p in enumerate(self.names)}
        # a symbol alone: its piece, and its node if longer pieces begin with it
        self.alone = np.full(len(symbols) + 256, -1, np.int32)
        for s, c in enumerate(symbols):
            self.alone[s] = number.get(c, -1)
        self.alone[self.bytes_from :] = np.arange(len(self.names) - 256, len(self.names))
        nodes = {n: i for i, n in enumerate(sorted({p[:k] for p in long for k in range(1, len(p))}))}
        self.root = np.full(len(symbols) + 256, -1, np.int32)
        self.step = np.full((len(nodes), len(inner)), -1, np.int32)
        self.piece = np.full((len(nodes), len(inner)), -1, np.int32)
        place = {c: i for i, c in enumerate(inner)}
        for n, i in nodes.items():
            if len(n) == 1:
                self.root[place[n]] = i
            else:
                self.step[nodes[n[:-1]], place[n[-1]]] = i
        for p in long:
            self.piece[nodes[p[:-1]], place[p[-1]]] = number[p]
        self.inner = len(inner)

    def __len__(self) -> int:
        return len(self.names)

    def words(self, text: str | None) -> list[str]:
        return letter_runs(text.lower()) if text else []

    def spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of all words behind one another, where each word's begin, and its number of them."""
        points = np.frombuffer("".join([MARK + w for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
        flat, sizes = self.symbol[points], np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.cumsum(sizes) - sizes
        strange = flat < 0
        if strange.any():
            wide = np.where(strange, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), 1)
            sizes = np.add.reduceat(wide, begin)
            begin = np.cumsum(sizes) - sizes
            flat, strange = np.repeat(flat, wide), np.repeat(strange, wide)
            flat[strange] = self.bytes_from + np.frombuffer(points[self.symbol[points] < 0].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        return flat, begin, sizes

    def lattices(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
        """Words of like length together: (their places in `words`, their sizes, edges by end: (begin, rows, pieces))."""
        if not words:
            return
        flat, begin, sizes = self.spelled(words)
        order = np.argsort(sizes, kind="stable")
        ranked, lo = sizes[order], 0
        while lo < len(order):
            most = int(ranked[lo]) * 9 // 8 + 2
            hi = lo + max(1, min(int(np.searchsorted(ranked, most, "right")) - lo, _CELLS // most))
            own, at = order[lo:hi], np.arange(int(ranked[hi - 1]))
            s = flat[np.minimum(begin[own][:, None] + at, len(flat) - 1)]
            s[at >= sizes[own][:, None]] = -1
            yield own, sizes[own], self._edges(s)
            lo = hi

    def _edges(self, s: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        width = s.shape[1]
        by_end: list[list] = [[] for _ in range(width + 1)]
        rows, begin = np.nonzero(s >= 0)
        sym = s[rows, begin]
        found, node, length = [(rows, begin, self.alone[sym])], self.root[sym], 1
        while True:
            live = (node >= 0) & (begin + length < width)
            rows, begin, node = rows[live], begin[live], node[live]
            sym = s[rows, begin + length]
            live = (sym >= 0) & (sym < self.inner)
            rows, begin, node, sym = rows[live], begin[live], node[live], sym[live]
            if not len(rows):
                break
            found.append((rows, begin, self.piece[node, sym]))
            node, length = self.step[node, sym], length + 1
        for n, (rows, begin, piece) in enumerate(found, 1):
            hit = np.flatnonzero(piece >= 0)
            hit = hit[np.argsort(begin[hit], kind="stable")]
            edges = np.flatnonzero(np.diff(begin[hit], prepend=-1, append=width + 1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                at = int(begin[hit[a]])
                by_end[at + n].append((at, rows[hit[a:b]], piece[hit[a:b]]))
        return by_end


def _forward(edges: list, n: int, logs: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Logarithms of what all ways to each place sum to: [row, place, language], or each row's own language where `of` names it.

    Sums are formed relative to the place before, from which they differ by a few pieces, so that words of any length fit.
    """
    width = len(edges) - 1
    out = np.zeros((n, width + 1, 1 if of is not None else logs.shape[1]))
    for e in range(1, width + 1):
        sums, ref = np.zeros_like(out[:, e]), out[:, e - 1]
        for s, rows, piece in edges[e]:
            p = logs[piece] if of is None else logs[piece, of[rows]][:, None]
            sums[rows] += np.exp(out[rows, s] + p - ref[rows])
        with np.errstate(divide="ignore"):
            out[:, e] = ref + np.log(sums)
        out[:, e][sums == 0] = ref[sums == 0]  # behind a shorter word's end
    return out


def word_scores(pieces: Pieces, words: list[str], logs: np.ndarray) -> np.ndarray:
    """Logarithm of each word's probability in each language."""
    out = np.zeros((len(words), logs.shape[1]))
    for own, sizes, edges in pieces.lattices(words):
        f = _forward(edges, len(own), logs)
        out[own] = f[np.arange(len(own)), sizes]
    return out


def expected_counts(pieces: Pieces, words: list[str], langs: np.ndarray, n: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Expected counts of pieces, [piece, language], of n occurrences of each word."""
    out = np.zeros(logs.shape)
    for own, sizes, edges in pieces.lattices(words):
        of, every = langs[own], np.arange(len(own))
        f = _forward(edges, len(own), logs, of)[:, :, 0]
        total = f[every, sizes]
        # behind: logarithms of what leads from a place to the word's end
        behind = np.full(f.shape, -np.inf)
        behind[every, sizes] = 0.0
        for e in range(len(edges) - 1, 0, -1):
            for s, rows, piece in edges[e]:
                p = logs[piece, of[rows]] + behind[rows, e]
                behind[rows, s] = np.logaddexp(behind[rows, s], p)
                weight = n[own[rows]] * np.exp(f[rows, s] + p - total[rows])
                np.add.at(out, (piece, of[rows]), weight)
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def learnable(docs: DataFrame, folds: int = 5) -> DataFrame:
    """(lang, text) of the rows that may be learned from: those whose crc32 of the id is not divisible by `folds`."""
    return docs.where((F.crc32(F.col("doc_id").cast("string")) % folds != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")


def word_table(texts: DataFrame, path: str) -> DataFrame:
    """(lang, word, n) of all letters' runs, and how many texts a language has with any, under the empty word."""

    def count(batches):
        p, held = vocabulary(path), Counter()

        def flush():
            keys = list(held)
            out = pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()), "word": pa.array([k[1] for k in keys], pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = Counter(p.words(text.as_py()))
                if found:
                    held[lang, ""] += 1
                    for w, n in found.items():
                        held[lang, w] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    return texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """langs in order; priors: of each; logs: [piece, language]."""

    def __init__(self, langs: list[str], priors: np.ndarray, logs: np.ndarray, path: str):
        self.langs, self.priors, self.logs, self.path = langs, priors, logs, path


def _logs(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """Smoothed towards all languages together, and those by one for each piece."""
    common = (counts.sum(axis=1) + 1) / (counts.sum() + len(counts))
    return np.log((counts + smoothing * common[:, None]) / (counts.sum(axis=0) + smoothing))


def learn(texts: DataFrame, path: str | None = None, rounds: int = ROUNDS, smoothing: float = SMOOTHING, max_langs: int = MAX_LANGS) -> Model:
    """texts(lang, text) -> Model. The driver sees languages and one number a piece and language at most."""
    path = path or default_model()
    words = cut(word_table(texts, path))
    priors = words.where("word = ''").select("lang", "n").limit(max_langs + 1).collect()
    if len(priors) > max_langs:
        raise ValueError(f"over {max_langs} languages")
    priors = {r.lang: r.n for r in sorted(priors, key=lambda r: r.lang)}
    langs, size = list(priors), len(vocabulary(path))
    model = Model(langs, np.log(np.array(list(priors.values()), float) / max(1, sum(priors.values()))), _logs(np.zeros((size, len(langs))), smoothing), path)
    seen = words.where("word <> ''")
    for _ in range(rounds if langs else 0):
        counts = np.zeros((size, len(langs)))
        for r in _expected(seen, model).groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow().to_batches():
            counts[r["piece"].to_numpy(), r["lang"].to_numpy()] = r["n"].to_numpy()
        model = Model(langs, model.priors, _logs(counts, smoothing), path)
    return model


def _expected(words: DataFrame, model: Model) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(model)  # a number for each piece and language: at most 46 MB

    def run(batches):
        m = shared.value
        number, total = {x: i for i, x in enumerate(m.langs)}, np.zeros(m.logs.shape)
        for b in batches:
            langs = np.array([number[x] for x in b.column(0).to_pylist()], np.int64)
            total += expected_counts(vocabulary(m.path), b.column(1).to_pylist(), langs, b.column(2).to_numpy().astype(float), m.logs)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": piece.astype(np.int32), "lang": lang.astype(np.int32), "n": total[piece, lang]})

    return words.select("lang", "word", "n").mapInArrow(run, "piece int, lang int, n double")


class Judge:
    """Scores texts in one task; words met before are remembered, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, vocabulary(model.path)
        self.most = max(1, min(HELD, (1 << 23) // max(1, len(model.langs))))
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.known = np.zeros((0, len(self.model.langs)))

    def _learn(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.known = np.concatenate([self.known, word_scores(self.pieces, new, self.model.logs)])

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [Counter(self.pieces.words(t)) for t in texts]
        if len(self.place) > self.most:
            self._forget()
        self._learn(dict.fromkeys(w for f in found for w in f))
        langs, scores = [], []
        for f in found:
            if not f or not self.model.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            at = np.fromiter((self.place[w] for w in f), np.int64, len(f))
            n = np.fromiter(f.values(), float, len(f))
            total = self.model.priors + n @ self.known[at]
            best = int(total.argmax())
            langs.append(self.model.langs[best])
            scores.append(round(1 / float(np.exp(total - total[best]).sum()), 6))
        return langs, scores


def predict(docs: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row, by its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = Judge(shared.value)
        for b in batches:
            for lo, hi in _spans(b.column(2)):
                part = b.slice(lo, hi - lo)
                langs, scores = judge.texts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "held_out": part.column(1), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def _spans(texts: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows of about a size."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t.as_py() or "")
        if held >= size or i + 1 == len(texts):
            yield at, i + 1
            at, held = i + 1, 0


def identify(docs: DataFrame, path: str | None = None, folds: int = 5) -> DataFrame:
    """Learns from the rows outside the held-out fold and predicts all."""
    return predict(docs, learn(learnable(docs, folds), path), folds)

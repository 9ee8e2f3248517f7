"""Spelling variants: vocabulary acceptor, one-edit transducer and acceptor composed; accepted pairs are listed by partitions of the initial state.

Two words one edit apart agree up to a first place of difference; there one letter is replaced, or stands in one of
them only; behind it they agree again. In the composition that is a walk over pairs of equal states, one arc that edits, and a walk over pairs of
states along equal letters to a pair of final ones. The walk before the edit is what deals the work: a partition is the state reached by a prefix.

* A state with more than LIMIT words under it is expanded by Spark itself, one step: its edits are a grouping by what the words are without the
  letter there (at most one member a letter of the alphabet, and the word that lacks one), and the states behind its arcs are partitions of their own. What all
  words of a partition begin with is passed in one step. The root is always expanded, so work is dealt by the first letter at least.
* A smaller one goes to a task, which builds the minimised acceptor of its words and composes. States are shared, so what can follow
  them is composed once: `edits` of a state, and `meets` of two. Words are numbered by their rank, which the acceptor gives by counting.

Cases: null and empty texts have no words; texts are taken whole, and words of any length; repeated rows count as often; rows with a null
doc_id have words but none of them is garbled; ties of a form go to the smaller word by code points; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.runtime import cut

#: Words of a partition at most; distinct words that a task counts before it passes them on; hot partitions that may be broadcast.
LIMIT, HELD, HOT = 4096, 250_000, 50_000

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def vocabulary(docs: DataFrame, min_length: int = 6, min_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n): words of enough length and occurrences; a run whose crc32 with its document's id is divisible by `every` loses a letter."""
    run = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")

    def count(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                found = Counter(run.findall((text.as_py() or b"").translate(_LOWER).decode()))
                start = zlib.crc32(f"{i}:".encode())
                for w, n in found.items():
                    h = zlib.crc32(w.encode(), start) if i is not None else 1
                    if h % every == 0:
                        h %= len(w)
                        w = w[:h] + w[h + 1 :]
                        if len(w) < min_length:
                            continue
                    held[w] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Acceptor:
    """The minimised acyclic acceptor of sorted distinct words; states are numbered so that an arc leads to a smaller number.

    arcs[q]: (letter, state, words of q before those behind this arc), by letter; final[q]; count[q]: words accepted from q.
    """

    def __init__(self, words: list[str]):
        self.arcs, self.final, self.count = [], [], []
        self._known: dict = {}
        path: list[list] = [[False, []]]  # open states: final, [letter, state or None]
        before = ""
        for w in words:
            same = 0
            top = min(len(w), len(before))
            while same < top and w[same] == before[same]:
                same += 1
            self._close(path, same)
            for c in w[same:]:
                path[-1][1].append([c, None])
                path.append([False, []])
            path[-1][0] = True
            before = w
        self._close(path, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, upto: int) -> None:
        while len(path) > upto + 1:
            q = self._state(*path.pop())
            path[-1][1][-1][1] = q

    def _state(self, final: bool, arcs: list) -> int:
        key = (final, *map(tuple, arcs))
        q = self._known.get(key)
        if q is None:
            n, out = int(final), []
            for c, to in arcs:
                out.append((c, to, n))
                n += self.count[to]
            q = self._known[key] = len(self.arcs)
            self.arcs.append(out)
            self.final.append(final)
            self.count.append(n)
        return q


_NONE = np.zeros((0, 2), np.int64)
_BOTH = np.zeros((1, 2), np.int64)


class Composition:
    """Acceptor, one edit and acceptor: pairs of ranks, each unordered pair once."""

    def __init__(self, a: Acceptor):
        self.a, self.met = a, {}
        self.ways = [{c: (to, n) for c, to, n in arcs} for arcs in a.arcs]

    def _shared(self, p: int, q: int):
        """Arcs that two states have in common: (state, state, rank, rank)."""
        x, y = self.a.arcs[p], self.ways[q]
        if len(self.a.arcs[q]) < len(x):
            return [(self.ways[p][c][0], to, self.ways[p][c][1], n) for c, to, n in self.a.arcs[q] if c in self.ways[p]]
        return [(to, y[c][0], n, y[c][1]) for c, to, n in x if c in y]

    def meets(self, p: int, q: int) -> np.ndarray:
        """Ranks, from p and from q, of what both accept."""
        todo = [(p, q) if p < q else (q, p)]
        met = self.met
        while todo:
            x, y = todo[-1]
            if (x, y) in met:
                todo.pop()
            elif x == y:
                met[x, y] = np.repeat(np.arange(self.a.count[x]), 2).reshape(-1, 2)
            else:
                shared = self._shared(x, y)
                open_ = [k for u, v, _, _ in shared if (k := (u, v) if u < v else (v, u)) not in met]
                if open_:
                    todo += open_
                    continue
                out = [_BOTH] if self.a.final[x] and self.a.final[y] else []
                for u, v, m, n in shared:
                    got = met[u, v] if u < v else met[v, u][:, ::-1]
                    if len(got):
                        out.append(got + (m, n))
                met[x, y] = np.concatenate(out) if len(out) > 1 else out[0] if out else _NONE
        return met[p, q] if p < q else met[q, p][:, ::-1]

    def _edits_here(self, q: int) -> list[np.ndarray]:
        """Pairs whose first difference is at this state."""
        arcs, out = self.a.arcs[q], []
        for i, (_, p, m) in enumerate(arcs):
            for _, r, n in arcs[i + 1 :]:
                got = self.meets(p, r)
                if len(got):
                    out.append(got + (m, n))
        for c, p, m in arcs:  # c before what q itself accepts; if that begins with c, the words differ later
            if self.a.final[q] and self.a.final[p]:
                out.append(np.array([[m, 0]]))
            for d, r, n in arcs:
                if d != c and d in self.ways[p]:
                    to, k = self.ways[p][d]
                    got = self.meets(to, r)
                    if len(got):
                        out.append(got + (m + k, n))
        return out

    def pairs(self) -> np.ndarray:
        """All accepted pairs from the start."""
        edits: list[np.ndarray] = []
        for q, arcs in enumerate(self.a.arcs):
            out = self._edits_here(q)
            out += [edits[p] + n for _, p, n in arcs if len(edits[p])]
            edits.append(np.concatenate(out) if out else _NONE)
        return edits[self.a.start]


def _links(words: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Both directions of some pairs."""
    w = pa.array(words, pa.string())
    here, there = pa.array(np.concatenate([i, j])), np.concatenate([j, i])
    return pa.RecordBatch.from_pydict({"word": w.take(here), "other": w.take(pa.array(there)), "other_n": n[there]})


def _best(words: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """For each word its near words' number and the best of them: largest n, then smallest word (ranks are in that order)."""
    here, there = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((there, -n[there], here))
    here, there = here[order], there[order]
    first = np.flatnonzero(np.diff(here, prepend=-1))
    w = pa.array(words, pa.string())
    size = np.diff(np.append(first, len(here)))
    return pa.RecordBatch.from_pydict({"word": w.take(pa.array(here[first])), "other": w.take(pa.array(there[first])), "other_n": n[there[first]], "near": size})


def _partition_pairs(batches, sink):
    """Rows (at, state, word, n), sorted by them -> what the sink makes of each partition's pairs."""
    key, words, counts = None, [], []

    def close():
        if len(words) > 1:
            found = Composition(Acceptor([w[len(key[1]) :] for w in words])).pairs()
            if len(found):
                yield sink(words, np.array(counts, np.int64), found[:, 0], found[:, 1])

    for b in batches:
        for at, state, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (at, state) != key:
                yield from close()
                key, words, counts = (at, state), [], []
            words.append(word)
            counts.append(n)
    yield from close()


def _common(a: str, b: str):
    """Length of what two columns' strings both begin with."""
    upto = F.least(F.length(a), F.length(b))
    return F.coalesce(F.array_max(F.filter(F.transform(F.sequence(F.lit(0), upto), lambda i: F.when(F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i), i)), lambda i: i.isNotNull())), F.lit(0))


def _edits_at(rows: DataFrame) -> DataFrame:
    """Rows (at, word, n), words of over-full states at their common prefix: links of words whose first difference is there."""
    at, word = F.col("at"), F.col("word")
    less = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    whole = F.struct(word.alias("text"), F.lit("").alias("letter"), "n")
    shorter = F.struct(less.alias("text"), F.substring(word, at + 1, F.lit(1)).alias("letter"), "n")
    cuts = rows.select("at", F.explode(F.when(F.length(word) > at, F.array(whole, shorter)).otherwise(F.array(whole))).alias("x")).select("at", "x.*")
    groups = cuts.groupBy("at", "text").agg(F.collect_list(F.struct("letter", "n")).alias("m")).where(F.size("m") > 1)
    one = groups.select("at", "text", "m", F.explode("m").alias("own"))
    two = one.select("at", "text", "own", F.explode("m").alias("other")).where("own.letter <> other.letter")
    follows = F.substring("text", F.col("at") + 1, F.lit(1))
    real = lambda a, b: (F.col(f"{a}.letter") != "") | (F.col(f"{b}.letter") != follows)
    full = lambda c: F.concat(F.substring("text", F.lit(1), F.col("at")), F.col(f"{c}.letter"), F.substring("text", F.col("at") + 1, F.length("text")))
    return two.where(real("own", "other") & real("other", "own")).select(full("own").alias("word"), full("other").alias("other"), F.col("other.n").alias("other_n"))


def _composed(words: DataFrame, limit: int, sink, fields: str, native) -> DataFrame:
    parts, small = [], []
    live, root = words.select(F.lit(0).alias("at"), "word", "n"), True
    while True:
        state = F.substring("word", F.lit(1), F.col("at")).alias("state")
        if root:
            over = live
        else:
            live = cut(live)
            sizes = live.groupBy("at", state).agg(F.count("*").alias("size"), F.min("word").alias("a"), F.max("word").alias("b")).where(F.col("size") > limit)
            sizes = cut(sizes.select("at", "state", _common("a", "b").alias("upto")))
            few = sizes.limit(HOT + 1).count()  # over-full states: as many as words / limit at most
            rows = live.select("at", state, "word", "n")
            if not few:
                small.append(rows)
                break
            rows = rows.join(F.broadcast(sizes) if few <= HOT else sizes, ["at", "state"], "left")
            small.append(rows.where("upto is null").select("at", "state", "word", "n"))
            over = rows.where("upto is not null").select(F.col("upto").alias("at"), "word", "n")
        parts.append(native(_edits_at(over)))
        live, root = over.where(F.length("word") > F.col("at")).select((F.col("at") + 1).alias("at"), "word", "n"), False
    dealt = small[0]
    for s in small[1:]:
        dealt = dealt.unionByName(s)
    sorted_ = dealt.repartition("at", "state").sortWithinPartitions("at", "state", "word")
    out = sorted_.mapInArrow(lambda batches: _partition_pairs(batches, sink), fields)
    for p in parts:
        out = out.unionByName(p)
    return out


def near_pairs(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """words(word, n), distinct -> (word, other, other_n) of all words one inserted, deleted or replaced code point apart, both ways."""
    return _composed(words, limit, _links, "word string, other string, other_n long", lambda p: p)


def forms(words: DataFrame, ratio: int = 5, limit: int = LIMIT) -> DataFrame:
    """(word, n, n_near, form, form_n): form, the near word of largest n, if that is at least `ratio` times the word's."""
    linked = _composed(words, limit, _best, "word string, other string, other_n long, near long", lambda p: p.withColumn("near", F.lit(1).cast("long")))
    least = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other")))
    near = linked.groupBy("word").agg(F.sum("near").alias("n_near"), least.alias("best"))
    fits = -F.col("best.minus") >= ratio * F.col("n")
    return words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n"))


def roots(table: DataFrame, ratio: int = 5) -> DataFrame:
    """Adds root, from word over forms to the last. Along forms n grows by `ratio` at least, which bounds the rounds of pointer doubling."""
    if ratio < 2:
        raise ValueError("a form has to occur more often than its word")
    most = table.agg(F.max("form_n")).first()[0]
    if most is None:
        return table.withColumn("root", F.col("word"))
    links = 1 + int(math.log(most, ratio)) + 1
    to = table.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(1, links - 1).bit_length()):
        onward = to.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        to = cut(to.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
    return table.join(to, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, every: int = 199, ratio: int = 5, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the documents."""
    words = cut(vocabulary(docs, min_length, min_count, every))
    table = cut(forms(words, ratio, limit))
    return roots(table, ratio).select("word", "form", "root", "n", "n_near", "form_n")


def oracle(min_length: int = 6, min_count: int = 5, every: int = 199, ratio: int = 5) -> str:
    """The same in SQL: crc32 by its table, near words by the words without one letter."""
    table = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        table.append(b)
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(b AS BIGINT) FOR b IN bytes]), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295)"
    return f"""
WITH RECURSIVE found AS (
  SELECT doc_id, w, length(w) AS size, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) r
  WHERE length(w) >= {min_length} GROUP BY ALL
), hashed AS (
  SELECT *, {crc} AS h FROM (
    SELECT *, [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR) || ':' || w)), '..')] AS bytes, CAST({table} AS BIGINT[]) AS t FROM found) f
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {every} = 0 THEN substr(w, 1, h % size) || substr(w, h % size + 2) ELSE w END AS word, n FROM hashed) g
  WHERE length(word) >= {min_length} GROUP BY word HAVING sum(n) >= {min_count}
), less AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) x
), near AS (
  SELECT DISTINCT * FROM (
    SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word) y
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS form_n, arg_min(other, (-other_n, other)) AS form FROM near GROUP BY word
), told AS MATERIALIZED (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {ratio} * n THEN form END AS form, CASE WHEN form_n >= {ratio} * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS at, form AS onward FROM told
  UNION ALL SELECT walk.word, told.word, told.form FROM walk JOIN told ON told.word = walk.onward
)
SELECT told.word, told.form, walk.at AS root, n, n_near, form_n FROM told JOIN walk ON walk.word = told.word AND walk.onward IS NULL"""

"""LM scoring with a weighted backoff automaton.

The model holds all words, and all n-grams of two and three words that training documents hold at
least twice; its counts, probabilities and backoff weights stay distributed. n-grams whose share of
all tokens is at least ``SHARE`` become states and arcs of an automaton: an arc carries a smoothed
log probability, a failure arc a backoff weight to the next shorter history. There can be no more
than 1 / SHARE of them per order, which bounds what is broadcast at any size of corpus. One
left-to-right traversal of each text carries the state. All other n-grams, and words outside the
automaton's table, are found by a join: what one adds to the automaton's score of a text does not
depend on its neighbours, so it is added up by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkbook.llm.hashing import scramble, slices, word_hashes
from linkbook.plans.staging import stage

SHARE = 1e-6
# Most frequent words that the automaton carries with their counts; the count that cuts them is
# taken from the counts of counts, so that no more than these fit.
TABLE_WORDS = 300_000
DISCOUNT = 0.75
PRIOR = 0.1
# Tokens a task sums up at once.
CHUNK_TOKENS = 6_000_000
# Tokens whose rarer n-grams a task holds at once: about 130 bytes each while they are counted.
REST_TOKENS = 1_000_000
END = np.uint64(0x5E2D58D8B3BCDEF1)  # stands for the end of a text
_WORD = 21  # bits of a word's number in an n-gram's key


@dataclass
class Table:
    """Sorted hashes of the frequent words, their counts, their numbers in n-grams (-1: in none), and N and V."""

    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    tokens: int
    distinct: int

    @property
    def begin(self) -> int:
        return int(self.ids.max(initial=-1)) + 1

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the table, -1 if it is not there."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes)
        return np.where(at >= 0, np.append(self.ids, -1)[at], -1)


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column as token hashes, each row ending with END, and the rows' first tokens."""
    for at, to, content, offsets in slices(column):
        hashes, first = word_hashes(content, offsets, lower=True)
        yield at, to, np.insert(hashes, first[1:], END), first + np.arange(to - at + 1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def sums() -> pa.RecordBatch:
        words, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

    for batch in batches:
        for _, _, hashes, _ in _tokens(batch.column("text")):
            held.append(hashes)
            if sum(map(len, held)) >= CHUNK_TOKENS // 2:
                yield sums()
    if held:
        yield sums()


def _grams(ids: np.ndarray, first: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bigrams and trigrams of numbered words; a text's first word follows ``begin``."""
    one = np.insert(ids, first[:-1], begin)  # begin before each row
    two = np.where((one[:-1] >= 0) & (one[1:] >= 0) & (one[1:] != begin), (one[:-1] << _WORD) | one[1:], -1)
    three = np.where((two[:-1] >= 0) & (two[1:] >= 0), (two[:-1] << _WORD) | one[2:], -1)
    return two[two >= 0], three[three >= 0]


def _count_grams(table: Table, share: float, wanted: tuple[np.ndarray, np.ndarray] | None):
    """Arrow function: (text) -> (size, gram, n, slack).

    Without ``wanted``, what a chunk of n tokens holds at least share * n / 2 times; ``slack`` is
    what a chunk may have left out. With ``wanted``, exact counts of those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        tokens = 0

        def sums() -> Iterator[pa.RecordBatch]:
            least = max(1, int(np.ceil(share * tokens / 2)))
            for k in (0, 1):
                keys = np.concatenate(held[k]) if held[k] else np.zeros(0, np.int64)
                held[k].clear()
                if wanted is not None:
                    keys = keys[np.isin(keys, wanted[k])]
                grams, counts = np.unique(keys, return_counts=True)
                if wanted is None:
                    grams, counts = grams[counts >= least], counts[counts >= least]
                size = pa.array(np.full(len(grams), k + 2, np.int32))
                slack = pa.array(np.full(len(grams), least - 1))
                yield pa.RecordBatch.from_arrays([size, pa.array(grams), pa.array(counts), slack], ["size", "gram", "n", "slack"])
            if wanted is None:
                row = [pa.array([0], pa.int32()), pa.array([0]), pa.array([0]), pa.array([least - 1])]
                yield pa.RecordBatch.from_arrays(row, ["size", "gram", "n", "slack"])

        for batch in batches:
            for _, _, hashes, first in _tokens(batch.column("text")):
                two, three = _grams(table.numbers(hashes), first, table.begin)
                held[0].append(two)
                held[1].append(three)
                tokens += len(hashes)
                if tokens >= 2 * CHUNK_TOKENS:
                    yield from sums()
                    tokens = 0
        if tokens:
            yield from sums()

    return run


def _names(table: Table, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each token's place in the table, below zero for words outside it; the beginning stands before each row."""
    places = table.places(hashes)
    names = np.where(places >= 0, places, (hashes | np.uint64(1 << 63)).view(np.int64))
    return np.insert(names, first[:-1], len(table.hashes))


def _mixed(*words: np.ndarray) -> np.ndarray:
    total = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        total = scramble(total + w.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return total.view(np.int64)


def _rest(table: Table, often: tuple[np.ndarray, np.ndarray], names: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """For two and three words: places of the n-grams outside the automaton by their last word, and their words."""
    begin = len(table.hashes)
    ids = np.append(table.ids, [table.begin, -1])[np.where(names >= 0, names, begin + 1)]
    out = []
    last = np.flatnonzero(names[1:] != begin) + 1
    for k in (2, 3):
        if k == 3:
            last = last[names[last - 1] != begin]
        words = [names[last - i] for i in range(k - 1, -1, -1)]
        numbers = [ids[last - i] for i in range(k - 1, -1, -1)]
        numbered = np.all([n >= 0 for n in numbers], axis=0) if len(last) else np.zeros(0, bool)
        gram = np.zeros(len(last), np.int64)
        for n in numbers:
            gram = (gram << _WORD) | np.maximum(n, 0)
        held = often[k - 2]
        if len(held):
            at = np.minimum(np.searchsorted(held, gram), len(held) - 1)
            numbered &= held[at] == gram
        else:
            numbered[:] = False
        out.append((last[~numbered], [w[~numbered] for w in words]))
    return out


def _count_rest(table: Table, often: tuple[np.ndarray, np.ndarray]):
    """Arrow function: (text) -> (u, v, w, n) of the n-grams outside the automaton; u is null for two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sums() -> Iterator[pa.RecordBatch]:
            names = np.concatenate(held)
            held.clear()
            for _, words in _rest(table, often, names):
                _, at, n = np.unique(_mixed(*words), return_index=True, return_counts=True)
                parts = [pa.array(w[at]) for w in words]
                if len(parts) == 2:
                    parts.insert(0, pa.nulls(len(at), pa.int64()))
                yield pa.RecordBatch.from_arrays([*parts, pa.array(n, pa.int64())], ["u", "v", "w", "n"])

        for batch in batches:
            for _, _, hashes, first in _tokens(batch.column("text")):
                held.append(_names(table, hashes, first))
                if sum(map(len, held)) >= REST_TOKENS:
                    yield from sums()
        if held:
            yield from sums()

    return run


def _find_rest(table: Table, often: tuple[np.ndarray, np.ndarray]):
    """Arrow function: (key, text) -> (key, gram): n-grams outside the automaton, as often as a text holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, hashes, first in _tokens(batch.column("text")):
                names = _names(table, hashes, first)
                keys = batch.column("key").slice(at, to - at).to_numpy()
                ends = first[1:] + np.arange(1, len(first))
                for last, words in _rest(table, often, names):
                    rows = np.searchsorted(ends, last, "right")
                    yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), pa.array(_mixed(*words))], ["key", "gram"])

    return run


def _named_grams(table: Table):
    """Arrow function: (size, gram, n) of the automaton -> (u, v, w, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(table.begin + 1, len(table.hashes), np.int64)
        known = np.flatnonzero(table.ids >= 0)
        place[table.ids[known]] = known
        mask = (1 << _WORD) - 1
        for batch in batches:
            size, gram = batch.column("size").to_numpy(), batch.column("gram").to_numpy()
            u, v, w = (place[(gram >> by) & mask] for by in (2 * _WORD, _WORD, 0))
            yield pa.RecordBatch.from_arrays([pa.array(u, mask=size == 2), pa.array(v), pa.array(w), batch.column("n")], ["u", "v", "w", "n"])

    return run


def _named_words(table: Table):
    """Arrow function: (word, n) -> (id, word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("word").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_names(table, hashes, np.zeros(1, np.int64))), batch.column("word"), batch.column("n")], ["id", "word", "n"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, w, more) -> (gram, more)."""
    for batch in batches:
        u, v, w = (batch.column(c) for c in "uvw")
        three = u.is_valid().to_numpy(zero_copy_only=False)
        first = u.fill_null(0).to_numpy()
        gram = np.where(three, _mixed(first, v.to_numpy(), w.to_numpy()), _mixed(v.to_numpy(), w.to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(gram), batch.column("more")], ["gram", "more"])


class Automaton:
    """States are histories; an arc has a log probability and a next state, a state a backoff weight and a shorter state.

    ``back`` has the log weights of the numbered words and of the beginning, ``back_two`` those of n-grams of
    two words; both cover all n-grams of the model, also those that are not here.
    """

    def __init__(self, table: Table, two: dict[int, int], three: dict[int, int], documents: int, back: np.ndarray, back_two: dict[int, float]) -> None:
        mask = (1 << _WORD) - 1
        by_id = np.zeros(table.begin + 1)
        known = table.ids >= 0
        by_id[table.ids[known]] = table.counts[known]
        history = by_id.tolist()
        history[table.begin] = documents
        self.word_state = list(range(1, table.begin + 2))
        self.back, self.fail = [0.0, *back.tolist()], [0] * (table.begin + 2)
        pairs: dict[int, int] = {}
        for gram, weight in back_two.items():
            pairs[gram] = len(self.back)
            self.back.append(weight)
            self.fail.append(self.word_state[gram & mask])
        self.arcs: dict[int, int] = {}
        self.log_p: list[float] = []
        self.next: list[int] = []

        def arc(state: int, word: int, p: float, to: int) -> None:
            self.arcs[(state << _WORD) | word] = len(self.log_p)
            self.log_p.append(float(np.log10(p)))
            self.next.append(to)

        for gram, count in two.items():
            v, w = gram >> _WORD, gram & mask
            arc(self.word_state[v], w, (count - DISCOUNT) / history[v], pairs.get(gram, self.word_state[w]))
        for gram, count in three.items():
            pair, w = gram >> _WORD, gram & mask
            tail = ((pair & mask) << _WORD) | w
            arc(pairs[pair], w, (count - DISCOUNT) / two[pair], pairs.get(tail, self.word_state[w]))
        self.start = self.word_state[table.begin]

    def score(self, ids: list[int], alone: list[float]) -> float:
        """Log10 probability of a text; ``alone`` has each token's own log probability (0: added later)."""
        arcs, log_p, following, back, fail, begin = self.arcs, self.log_p, self.next, self.back, self.fail, self.word_state
        state, total = self.start, 0.0
        for w, own in zip(ids, alone, strict=True):
            if w >= 0:
                k = arcs.get((state << _WORD) | w)
                while k is None and state:
                    total += back[state]
                    state = fail[state]
                    k = arcs.get((state << _WORD) | w)
                if k is not None:
                    total += log_p[k]
                    state = following[k]
                    continue
                state = begin[w]
            else:
                while state:
                    total += back[state]
                    state = fail[state]
            total += own
        return total


def _score(table: Table, build):
    """Arrow function: (doc_id, held_out, text, key) -> sums over the known tokens, and the other tokens with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, back = build()
        z = table.tokens + PRIOR * (table.distinct + 1)
        alone = np.append(np.log10((table.counts + PRIOR) / z), 0.0)
        # A word without a number is no state: its weight goes with it.
        reset = alone + np.append(np.where(table.ids < 0, back, 0.0), 0.0)
        for batch in batches:
            for at, to, hashes, first in _tokens(batch.column("text")):
                places = table.places(hashes)
                ids, own, used = np.append(table.ids, -1)[places], alone[places], reset[places]
                n, known, base, score, rare, times = [], [], [], [], [], []
                for i in range(to - at):
                    a, b = first[i], first[i + 1]
                    other, count = np.unique(hashes[a:b][places[a:b] < 0], return_counts=True)
                    n.append(int(b - a))
                    known.append(int(b - a - count.sum()))
                    base.append(float(own[a:b].sum()))
                    score.append(automaton.score(ids[a:b].tolist(), used[a:b].tolist()))
                    rare.append(other.view(np.int64))
                    times.append(count)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, to - at), batch.column("held_out").slice(at, to - at),
                        batch.column("key").slice(at, to - at), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                        pa.array(score, pa.float64()), pa.array(rare, longs), pa.array(times, longs),
                    ],
                    ["doc_id", "held_out", "key", "n_tokens", "known", "base", "scored", "rare", "times"],
                )

    return run


def _arrays(df: DataFrame, *columns: str) -> list[np.ndarray]:
    table = df.select(*columns).toArrow()
    return [table.column(c).combine_chunks().to_numpy() if len(table) else np.zeros(0, np.int64) for c in columns]


def _table(counts: DataFrame, tokens: int, distinct: int, share: float, most: int) -> Table:
    """The most frequent words, at most ``most``; those with ``share`` of all tokens get numbers, by count."""
    clipped = F.least(F.col("n"), F.lit(1_000_000))
    upto = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    of_counts = counts.groupBy(clipped.alias("c")).agg(F.count("*").alias("words"))
    cut = of_counts.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") <= most).agg(F.min("c")).first()[0]
    words, n = _arrays(counts.where(clipped >= (cut if cut is not None else 1_000_001)), "word", "n")
    hashes = words.view(np.uint64)
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    ids = np.full(len(n), -1, np.int64)
    often = np.flatnonzero(n >= max(2, share * tokens))
    ids[often[np.lexsort([hashes[often], -n[often]])]] = np.arange(len(often))
    return Table(hashes, n, ids, tokens, distinct)


def score(docs: DataFrame, share: float = SHARE, table_words: int = TABLE_WORDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Probabilities: of a word alone (count + 0.1) / (N + 0.1 (V + 1)), of a word after one or two
    others (count - 0.75) / (count of these), the rest backed off, so that each history's
    probabilities sum to 1 over V words and one unknown. A null text is empty: its end is its
    only token. A null id is held out. Without training documents every probability is 1 (score 0). Rows
    that repeat are learnt from and scored as often as they stand. An empty table gives no rows;
    further columns are not read.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    learnt = rows.where("not held_out").select("text")
    counts = stage(
        learnt.mapInArrow(_count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "lm-words"
    )
    whole = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    tokens, distinct = whole["tokens"] or 0, whole["distinct"]
    ends = counts.where(F.col("word") == int(END.view(np.int64))).first()
    table = _table(counts, tokens, distinct, share, table_words)
    # Fewer and larger tasks where the input is small: a chunk's threshold is a share of its tokens.
    chunked = learnt.coalesce(max(1, tokens // CHUNK_TOKENS))
    schema = "size int, gram bigint, n bigint, slack bigint"
    local = stage(chunked.mapInArrow(_count_grams(table, share, None), schema), "lm-grams")
    slack = local.where("size = 0").agg(F.sum("slack")).first()[0] or 0
    # A chunk that says nothing of an n-gram may have left out its slack; no frequent n-gram is lost.
    least = max(2, share * tokens)
    hopeful = local.where("size > 0").groupBy("size", "gram").agg((F.sum("n") + slack - F.sum("slack")).alias("most")).where(F.col("most") >= least)
    size, gram = _arrays(stage(hopeful, "lm-hopeful"), "size", "gram")
    wanted = (np.sort(gram[size == 2]), np.sort(gram[size == 3]))
    exact = chunked.mapInArrow(_count_grams(table, share, wanted), schema).groupBy("size", "gram").agg(F.sum("n").alias("n"))
    exact_grams = stage(exact.where(F.col("n") >= least), "lm-exact")
    size, gram, n = _arrays(exact_grams.orderBy("size", "gram"), "size", "gram", "n")
    often = (np.sort(gram[size == 2]), np.sort(gram[size == 3]))
    grams = [dict(zip(gram[size == k].tolist(), n[size == k].tolist(), strict=True)) for k in (2, 3)]
    documents = ends["n"] if ends else 0
    model = _model(counts, learnt, exact_grams, table, often, documents)
    # Weights of the words of the table, and of the automaton's n-grams of two words.
    at, back = _arrays(model.back.where(F.col("v").between(0, len(table.hashes))), "v", "back")
    backs = np.zeros(len(table.hashes) + 1)
    backs[at] = back
    v, w, back = _arrays(model.back_two.where("often").select("v", "w", "back"), "v", "w", "back")
    ids = np.append(table.ids, table.begin)
    back_two = dict(zip(((ids[v] << _WORD) | ids[w]).tolist(), back.tolist(), strict=True))
    pieces = docs.sparkSession.sparkContext.broadcast((table, grams, documents, backs, back_two))

    def build() -> tuple[Automaton, np.ndarray]:
        t, (two, three), d, all_back, pair_back = pieces.value
        numbered = np.zeros(t.begin + 1)
        known = np.append(t.ids, t.begin)
        numbered[known[known >= 0]] = all_back[known >= 0]
        return Automaton(t, two, three, d, numbered, pair_back), all_back[:-1]

    return _finished(rows, model, table, often, build)


@dataclass
class Model:
    """What is joined: ``words`` (word, n, back), ``back`` (v, back), ``back_two`` (v, w, often, back) and ``rest`` (gram, more)."""

    words: DataFrame
    back: DataFrame
    back_two: DataFrame
    rest: DataFrame


def _model(counts: DataFrame, learnt: DataFrame, exact: DataFrame, table: Table, often: tuple[np.ndarray, np.ndarray], documents: int) -> Model:
    """Probabilities and backoff weights over all n-grams that occur at least twice.

    With log weights, the score of a word after two others is that of the word alone, plus the weight
    of the word before it, plus what the pair adds, plus the pair's weight, plus what the three add.
    So an n-gram's share in a text's score is the same wherever it stands.
    """
    schema = "u bigint, v bigint, w bigint, n bigint"
    # Chunks are summed up already and most n-grams stand once: another sum before the exchange would only spill.
    dealt = learnt.mapInArrow(_count_rest(table, often), schema).repartition("u", "v", "w")
    rest = dealt.groupBy("u", "v", "w").agg(F.sum("n").alias("n")).where("n > 1")
    named = exact.mapInArrow(_named_grams(table), schema)
    grams = stage(named.withColumn("often", F.lit(True)).unionByName(rest.withColumn("often", F.lit(False))), "lm-model")
    start = counts.sparkSession.range(1).select(F.lit(len(table.hashes)).cast("long").alias("id"), F.lit(None).cast("long").alias("word"), F.lit(documents).cast("long").alias("n"))
    numbered = counts.mapInArrow(_named_words(table), "id bigint, word bigint, n bigint")
    words = stage(numbered.unionByName(start), "lm-numbered")
    z = F.lit(table.tokens + PRIOR * (table.distinct + 1))
    weight = F.log10(F.greatest(1 - F.sum("p"), F.lit(1e-12)) / F.greatest(1 - F.sum("lower"), F.lit(1e-12))).alias("back")
    two = grams.where("u is null").join(words.select(F.col("id").alias("v"), F.col("n").alias("of")), "v").join(
        words.select(F.col("id").alias("w"), ((F.col("n") + PRIOR) / z).alias("lower")), "w"
    ).select("v", "w", "n", "often", "lower", ((F.col("n") - DISCOUNT) / F.col("of")).alias("p"))
    two = stage(two, "lm-two")
    back = stage(two.groupBy("v").agg(weight), "lm-back")
    three = grams.where("u is not null").join(two.select(F.col("v").alias("u"), F.col("w").alias("v"), F.col("n").alias("of")), ["u", "v"]).join(
        two.select("v", "w", F.col("p").alias("lower")), ["v", "w"]
    ).select("u", "v", "w", "often", "lower", ((F.col("n") - DISCOUNT) / F.col("of")).alias("p"))
    three = stage(three, "lm-three")
    back_two = stage(
        three.groupBy("u", "v").agg(weight).select(F.col("u").alias("v"), F.col("v").alias("w"), "back")
        .join(two.select("v", "w", "often"), ["v", "w"]), "lm-back-two",
    )
    more_two = two.where("not often").join(back, "v").join(back_two.select("v", "w", F.col("back").alias("own")), ["v", "w"], "left").select(
        F.lit(None).cast("long").alias("u"), "v", "w", (F.log10("p") - F.log10("lower") - F.col("back") + F.coalesce("own", F.lit(0.0))).alias("more")
    )
    more_three = three.where("not often").join(back_two.select(F.col("v").alias("u"), F.col("w").alias("v"), "back"), ["u", "v"]).select(
        "u", "v", "w", (F.log10("p") - F.log10("lower") - F.col("back")).alias("more")
    )
    keyed = more_two.unionByName(more_three).mapInArrow(_keyed, "gram bigint, more double")
    joined = words.where("word is not null and id < 0").join(back.withColumnRenamed("v", "id"), "id", "left").select("word", "n", F.coalesce("back", F.lit(0.0)).alias("back"))
    return Model(joined, back, back_two, keyed)


def _finished(rows: DataFrame, model: Model, table: Table, often: tuple[np.ndarray, np.ndarray], build) -> DataFrame:
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, held_out boolean, key bigint, n_tokens bigint, known bigint, base double, scored double, "
        "rare array<bigint>, times array<bigint>"
    )
    z = table.tokens + PRIOR * (table.distinct + 1)
    keyed = rows.withColumn("key", F.xxhash64("text"))
    scored = stage(
        keyed.mapInArrow(_score(table, build), schema).withColumn("row", F.monotonically_increasing_id()), "lm-scored"
    )
    others = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("o")).select(
        "row", F.col("o.rare").alias("word"), F.col("o.times").alias("times")
    )
    count = F.coalesce("n", F.lit(0))
    alone = F.log10((count + PRIOR) / F.lit(z))
    found = others.join(model.words, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * alone).alias("more"),
        F.sum(F.col("times") * (alone + F.coalesce("back", F.lit(0.0)))).alias("more_score"),
        F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    # Equal texts hold the same n-grams: their sum is that of one text times their number.
    held = keyed.select("key", "text").mapInArrow(_find_rest(table, often), "key bigint, gram bigint")
    sums = held.join(model.rest, "gram").groupBy("key").agg(F.sum("more").alias("grams"))
    sums = sums.join(scored.groupBy("key").agg(F.count("*").alias("copies")), "key").select("key", (F.col("grams") / F.col("copies")).alias("grams"))
    known = F.col("known") + F.coalesce("more_known", F.lit(0))
    base, whole = F.col("base") + F.coalesce("more", F.lit(0.0)), F.col("scored") + F.coalesce("more_score", F.lit(0.0)) + F.coalesce("grams", F.lit(0.0))
    if table.tokens == 0:
        base = whole = F.lit(0.0)
    return scored.join(found, "row", "left").join(sums, "key", "left").select(
        "doc_id", "held_out", "n_tokens", known.alias("n_known"),
        F.lit(table.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), whole.alias("score"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op5: scores of all documents."""
    return score(spark.read.parquet(f"{folder}/documents.parquet"))

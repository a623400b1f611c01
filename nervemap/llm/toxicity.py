"""Toxicity of texts whose words may be disguised: a noisy channel is decoded first, and what it restores is scored.

A character language model (trigrams, counted over all texts by Spark) says which letters follow one another; a channel says how letters
are disguised: digits and signs that stand for letters, letters that are repeated, letters with spaces or signs between them. The
spellings of a disguised word make a lattice, and its cheapest path by both is found by Viterbi's program over the last two letters. Where
letters are repeated and nothing else, the ways around a repetition meet again in the same two letters, so each is decided by itself, which
gives the same path; a word that can't be disguised has one path only.

A restored word's evidence is how much more often it, or a beginning of it, stands in toxic texts than in others, summed over labelled
texts in a table of fixed size. A text is described by the shares of its words above several levels of evidence, of which a
small network with a fitted temperature makes a probability. Evidence and network are learnt from different labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nervemap.llm.quality import Network, held_out
from nervemap.runtime import trimmed

#: Symbols of the language model: 0 what is no letter, 1 to 26 a to z, then those of à to ÿ, then all other letters.
SYMBOLS = 64
_LATIN, _OTHER = 27 - 0xE0, 60
#: Characters of a text that are looked at together; a longer one is cut at spaces.
STEP = 1 << 20
#: Buckets of the table of evidence, bytes of a word's first beginning that has one (two longer ones have too), and levels of evidence.
BUCKETS, BEGINNING = 1 << 17, 5
_MASK = BUCKETS - 1
LEVELS = np.array([-1, 0.25, 0.5, 1, 1.5, 2, 2.5, 3, 4])
FEATURES = len(LEVELS) + 1
#: Words that are remembered with their evidence.
REMEMBERED = 300_000

# Signs and the letters they stand for.
_STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Cost of each, in natural logarithms like the language model's.
SIGN, NOTHING, END, ONE_OF_TWO, ONE_OF_MANY, TWO_OF_MANY, JOINED, PARTED = 0.5, 6.0, 10.0, 4.0, 0.5, 1.0, 0.0, 6.0
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_FIRST = "".join(c for c in _MARKS if c not in _STANDS_FOR)
_BETWEEN = frozenset(" .-_*/|~,·")
_TWICE = re.compile(r"([^\W\d_])\1+")
_SIGN = re.compile("[" + re.escape("".join(_STANDS_FOR)) + "]")
_LETTER = re.compile(r"[^\W\d_]")
_SPACED = re.compile(r"(?:[^\s.\-_*/|~,·][.\-_*/|~,·]){2,}[^\s.\-_*/|~,·]")


def _symbol_table() -> np.ndarray:
    out = np.zeros(1 << 16, dtype=np.uint8)
    for c in range(1 << 16):
        if 97 <= c <= 122:
            out[c] = c - 96
        elif 0xE0 <= c <= 0xFF and c != 0xF7:
            out[c] = c + _LATIN
        elif not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = _OTHER
    return out


_SYMBOL = _symbol_table()


def portions(text: str | None) -> Iterator[str]:
    """A text in pieces of about ``STEP`` characters, cut at spaces (anywhere in a word longer than that)."""
    text, at = text or "", 0
    while at < len(text):
        end = len(text)
        if end - at > STEP:
            found = text.rfind(" ", at + 1, at + STEP)
            end = found if found > 0 else at + STEP
        yield text[at:end]
        at = end


def trigrams(text: str) -> np.ndarray:
    """Codes of the trigrams of symbols; words stand apart by two zeros, and none starts with the first of them after a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = np.where(points < 1 << 16, _SYMBOL[np.minimum(points, (1 << 16) - 1)], _OTHER).astype(np.int32)
    s = np.concatenate(([0], s, [0]))
    s = s[np.concatenate(([True], (s[1:] > 0) | (s[:-1] > 0)))]
    s = np.repeat(s, np.where(s == 0, 2, 1))
    a, b, c = s[:-2], s[1:-1], s[2:]
    real = (b > 0) | ((a == 0) & (c > 0))
    return (a[real] * SYMBOLS + b[real]) * SYMBOLS + c[real]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, held, size = np.zeros(SYMBOLS**3, dtype=np.int64), [], 0
    for batch in batches:
        for text in batch["text"]:
            for part in portions(text.as_py()):
                held.append(trigrams(part))
                size += len(held[-1])
                if size > STEP:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Cost (negative logarithm of the probability) of a symbol after two others, by code, from all texts; rarer contexts lean on shorter ones."""
    slim = docs.select(F.col(text_col).cast("string").alias("text"))
    n = np.zeros(SYMBOLS**3)
    # at most SYMBOLS ** 3 rows, whatever the texts
    for r in slim.mapInArrow(trimmed(_counted), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        n[r["code"]] = r["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = n.sum(axis=0), n.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 2 * p1) / (two.sum(axis=1, keepdims=True) + 2)
    p3 = (n + 2 * p2) / (n.sum(axis=2, keepdims=True) + 2)
    return -np.log(p3).astype(np.float32).reshape(-1)


class Channel:
    """Decodes words by the language model and the channel."""

    def __init__(self, costs: np.ndarray):
        self.costs: list[float] = costs.tolist()

    @staticmethod
    def _symbol(c: str) -> int:
        return int(_SYMBOL[ord(c)]) if ord(c) < 1 << 16 else _OTHER

    def _edges(self, c: str, times: int, joined: bool) -> list[tuple[float, str]]:
        """What ``times`` copies of a character may stand for, a space being the end of a word, and at which cost."""
        if c in _BETWEEN and joined:
            edges = [(JOINED, ""), (PARTED, " ")]
            return edges + [(SIGN, x) for x in _STANDS_FOR.get(c, "")]
        if self._symbol(c):
            if times == 1:
                return [(0.0, c)]
            return [(0.0, c + c), (ONE_OF_TWO, c)] if times == 2 else [(ONE_OF_MANY, c), (TWO_OF_MANY, c + c)]
        letters = _STANDS_FOR.get(c, "")
        edges = [(SIGN, x) for x in letters] + ([(SIGN + TWO_OF_MANY, x + x) for x in letters] if times > 1 else [])
        return edges + [(END if letters else 0.0, " ")] + ([] if c.isdigit() else [(NOTHING, "")])

    def decode(self, raw: str, joined: bool = False) -> str:
        """The cheapest words that ``raw`` may stand for; ``joined``: signs and spaces between its letters may be there to part them."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        at, raw = 0, raw.lower()
        while at < len(raw):
            c, end = raw[at], at + 1
            while end < len(raw) and raw[end] == c:
                end += 1
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            edges = self._edges(c, end - at, joined)
            for (a, b), (cost, path) in best.items():
                for more, out in edges:
                    x, y, total, way = a, b, cost + more, path
                    for o in out:
                        if o == " ":
                            if y:
                                total += self.costs[(x * SYMBOLS + y) * SYMBOLS]
                                way = (way, o)
                            x = y = 0
                        else:
                            s = self._symbol(o)
                            total += self.costs[(x * SYMBOLS + y) * SYMBOLS + s]
                            x, y, way = y, s, (way, o)
                    if (known := after.get((x, y))) is None or total < known[0]:
                        after[x, y] = total, way
            best, at = after, end
        ends = ((cost + (self.costs[(x * SYMBOLS + y) * SYMBOLS] if y else 0.0), i, path) for i, ((x, y), (cost, path)) in enumerate(best.items()))
        out, path = [], min(ends, key=lambda e: e[:2])[2]
        while path is not None:
            path, o = path
            out.append(o)
        return "".join(reversed(out)).strip()

    def _repeated(self, m: re.Match) -> str:
        """One or two of a letter that stands there more often, as ``decode`` has it."""
        word, (start, end), c = m.string, m.span(), m[1]
        s = self._symbol(c)
        q = self._symbol(word[start - 1]) if start else 0
        t = self._symbol(word[end]) if end < len(word) else 0
        once, twice = (ONE_OF_TWO, 0.0) if end - start == 2 else (ONE_OF_MANY, TWO_OF_MANY)
        once += self.costs[(q * SYMBOLS + s) * SYMBOLS + t]
        twice += self.costs[(q * SYMBOLS + s) * SYMBOLS + s] + self.costs[(s * SYMBOLS + s) * SYMBOLS + t]
        return c if once < twice else c + c

    def restored(self, token: str) -> str:
        """The word, or words, that a token of a text stands for; marks around it are left out."""
        token = token.rstrip(_MARKS).lstrip(_FIRST).lower()
        if token.isalpha():
            return _TWICE.sub(self._repeated, token) if _TWICE.search(token) else token
        if _SPACED.fullmatch(token):
            return self.decode(token, joined=True)
        if _TWICE.search(token) or (_SIGN.search(token) and _LETTER.search(token)):
            return self.decode(token)
        return token


def tokens(text: str) -> tuple[list[str], list[str]]:
    """Tokens of a text, and those sequences of three or more characters standing alone that may be a word."""
    words = text.split()
    alone = np.fromiter(map(len, words), np.int64, len(words)) == 1
    if not alone.any():
        return words, []
    edge = np.flatnonzero(np.diff(np.concatenate(([0], alone.astype(np.int8), [0]))))
    starts, stops = edge[::2], edge[1::2]
    long = stops - starts > 2
    if not long.any():
        return words, []
    spaced = [" ".join(words[a:b]) for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True)]
    gone = np.zeros(len(words), bool)
    for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
        gone[a:b] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], spaced


def buckets(word: str) -> list[int]:
    """Of a restored word and its beginnings."""
    raw = word.encode("utf-8", "surrogatepass")
    out = [crc32(raw, 1) & _MASK]
    if len(raw) >= BEGINNING:
        out.append(crc32(raw[:BEGINNING]) & _MASK)
        if len(raw) > BEGINNING:
            out.append(crc32(raw[: BEGINNING + 1]) & _MASK)
            if len(raw) > BEGINNING + 1:
                out.append(crc32(raw[: BEGINNING + 2]) & _MASK)
    return out


class _Evidence(dict):
    """Token -> evidence of the words that it stands for, the largest of them."""

    def __init__(self, channel: Channel, table: np.ndarray):
        super().__init__()
        self.restored, self.at = channel.restored, table.tolist().__getitem__

    def of(self, words: str) -> float:
        return max((max(map(self.at, buckets(w))) for w in words.split()), default=0.0)

    def __missing__(self, token: str) -> float:
        words = token.lower()
        if not words.isalpha() or _TWICE.search(words):
            words = self.restored(token)
        found = max(map(self.at, buckets(words))) if words.isalpha() else self.of(words)
        if len(token) < 64:
            self[token] = found
        return found


def features(texts: list[str | None], channel: Channel, table: np.ndarray, known: _Evidence | None = None) -> np.ndarray:
    """A row a text: square roots of the shares of its words above each level of evidence, and the logarithm of their number."""
    known = _Evidence(channel, table) if known is None else known
    out = np.zeros((len(texts), FEATURES))
    for i, text in enumerate(texts):
        above, n = np.zeros(len(LEVELS)), 0
        for part in portions(text):
            words, spaced = tokens(part)
            found = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
            if spaced:
                found = np.concatenate([found, [known.of(w) for s in spaced for w in channel.decode(s, joined=True).split()]])
            some = found[found > LEVELS[1]]
            above[1:] += (some[:, None] > LEVELS[1:]).sum(axis=0)
            above[0] += np.count_nonzero(found > LEVELS[0])
            n += len(found)
            if len(known) > REMEMBERED:
                known.clear()
        out[i, :-1], out[i, -1] = np.sqrt(above / max(10, n)), np.log1p(n)
    return out


#: Weight of a text in the table of evidence, spread over its words; of one bucket at most this many words count.
UNIT, MOST = 1_000_000, 10


def _told(costs: np.ndarray):
    """Labelled texts to sums by bucket and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, total, of_token = Channel(costs), np.zeros((2, BUCKETS), dtype=np.int64), {}
        for batch in batches:
            for y, text in zip(batch["y"].to_pylist(), batch["text"], strict=True):
                counts, n = {}, 0
                for part in portions(text.as_py()):
                    words, spaced = tokens(part)
                    n += len(words)
                    for w in words:
                        at = of_token.get(w)
                        if at is None:
                            at = [b for x in channel.restored(w).split() for b in buckets(x)]
                            if len(of_token) < REMEMBERED and len(w) < 64:
                                of_token[w] = at
                        for b in at:
                            counts[b] = counts.get(b, 0) + 1
                    for s in spaced:
                        for w in channel.decode(s, joined=True).split():
                            n += 1
                            for b in buckets(w):
                                counts[b] = counts.get(b, 0) + 1
                for b, k in counts.items():
                    total[y, b] += UNIT * min(k, MOST) // max(20, n)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[1, at]), pa.array(total[0, at])], ["bucket", "toxic", "clean"])

    return run


def _described(costs: np.ndarray, table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(costs)
        known = _Evidence(channel, table)
        for batch in batches:
            x = features(batch["text"].to_pylist(), channel, table, known)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))
            yield batch.drop_columns(["text"]).append_column("x", flat)

    return run


@dataclass
class ToxicityModel:
    """Everything in it is of fixed size: costs of the language model, evidence by bucket, the network."""

    costs: np.ndarray
    table: np.ndarray
    network: Network
    channel: Channel = field(init=False, repr=False)

    def __post_init__(self):
        self.channel = Channel(self.costs)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.network.probability(features(texts, self.channel, self.table)) if texts else np.zeros(0)


def evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Logarithm of how much more of a toxic text than of a clean one a bucket's words make; near 0 where they were hardly met."""
    share = 100.0 / UNIT
    toxic, clean = toxic * share, clean * share
    if not n_toxic or not n_clean:
        return np.zeros(len(toxic))
    both = (toxic + clean) / (n_toxic + n_clean)
    return np.log((toxic + 2 * both + 0.02) / (n_toxic + 2)) - np.log((clean + 2 * both + 0.02 * n_clean / n_toxic) / (n_clean + 2))


def fit(
    docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = 60_000, folds: int = 4, fold: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> ToxicityModel:
    """The language model from all texts; evidence and network from at most ``sample`` labelled rows outside the held-out fold, chosen by a hash of
    the id: two thirds for evidence, the others for the network.

    Rows with a null label or id are no labels; of several labels of an id the smallest counts.
    """
    costs = language_model(docs, text_col)
    usable = labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold))
    usable = usable.groupBy(F.col(id_col).alias("id")).agg((F.min(F.col(target).cast("int")) > 0).cast("int").alias("y"))
    place = F.xxhash64("id", F.lit(seed))
    chosen = usable.orderBy(place, "id").limit(sample).withColumn("own", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(3)) < 2)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id")  # at most ``sample`` ids
    sums = rows.where("own").select("y", "text").mapInArrow(trimmed(_told(costs)), "bucket long, toxic long, clean long")
    total = np.zeros((2, BUCKETS), dtype=np.int64)
    for r in sums.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toLocalIterator():  # at most BUCKETS rows
        total[:, r["bucket"]] = r["toxic"], r["clean"]
    n = {r["y"]: r["n"] for r in rows.where("own").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = evidence(total[0], total[1], n.get(1, 0), n.get(0, 0))
    described = rows.where("not own").select("id", "y", "text").mapInArrow(trimmed(_described(costs, table)), f"id {docs.schema[id_col].dataType.simpleString()}, y int, x array<double>")
    # at most ``sample`` ids; of rows that share an id one is learnt from
    got = sorted(described.groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x")).collect(), key=lambda r: str(r["id"]))
    x, y = np.array([r["x"] for r in got]).reshape(-1, FEATURES), np.array([r["y"] for r in got], dtype=np.float64)
    if not len(x):  # nothing is known: a half for all
        return ToxicityModel(costs, table, Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), 0.0))
    return ToxicityModel(costs, table, Network.fit(x, y, hidden=8, seed=seed))


def with_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with the probability of being toxic and whether it reaches ``threshold``; only the text is read for it.

    Null and empty texts have a score like any others (that of no words); all rows and other columns stay, repeated rows too, but columns of
    the two names are replaced. Long texts are scored whole. An empty table gives an empty result.
    """
    kept = docs.drop(score_col, predicted_col)
    costs, table, network = model.costs, model.table, model.network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(costs)
        known = _Evidence(channel, table)
        for batch in batches:
            s = network.probability(features(batch[text_col].cast(pa.string()).to_pylist(), channel, table, known))
            yield batch.append_column(score_col, pa.array(s)).append_column(predicted_col, pa.array((s >= threshold).astype(np.int32)))

    schema = T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())])
    return kept.mapInArrow(trimmed(run), schema)


def with_restored(docs: DataFrame, costs: np.ndarray, text_col: str = "text", restored_col: str = "restored") -> DataFrame:
    """``docs`` with the words of each text as they are scored, restored and in lower case, those of spaced letters last; null for null."""
    kept = docs.drop(restored_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(costs)
        for batch in batches:
            out = []
            for text in batch[text_col].cast(pa.string()).to_pylist():
                words = []
                for part in portions(text):
                    plain, spaced = tokens(part)
                    words += [*filter(None, map(channel.restored, plain)), *(channel.decode(s, joined=True) for s in spaced)]
                out.append(None if text is None else " ".join(words))
            yield batch.append_column(restored_col, pa.array(out, pa.string()))

    return kept.mapInArrow(trimmed(run), T.StructType([*kept.schema.fields, T.StructField(restored_col, T.StringType())]))

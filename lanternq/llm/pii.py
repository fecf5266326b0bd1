"""Problem 5: personal information in free text, by a linear-chain conditional random field over word shapes.

The field is trained on the small labelled table of pii_examples, filled with invented values and, if given, the entries of a name list
(at most MAX_NAMES of them; the list is only a feature, names outside it are found by shape and context). Besides shapes and the words of
the table it sees how common a word is, read from the vocabularies of public tokenizers. Texts are cut into segments at blank and
dashed lines; each distinct segment of the whole corpus is decoded once, by Viterbi in numpy batches, and the findings are joined back
by 128 bits of the segment's hashes.

Defined results: null and empty texts hold nothing; rows with a null key are left out; repeated rows give a finding once; texts of
any length are decoded whole, very long segments in overlapping windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternq.llm import crf
from lanternq.llm import hashing as H
from lanternq.llm.encoding import TOKENIZER_DIR, load_encoding
from lanternq.llm.pii_examples import KINDS, LABELLED, RESEMBLING, labelled_texts, table_lines
from lanternq.session import materialize

TOKEN = re.compile(r"[^\W\d_]+|\d+|\S")
SEPARATOR = r"\n(?=[ \t\r-]*\n)"
MAX_NAMES = 20_000
#: Fields whose weights are averaged, fillings of each line of the table for each of them, and random lines for each of those.
PARTS, PER_LINE, MIXED = 8, 12, 0.5
#: Added to the score of a token outside any span: the table holds more to be found than texts do.
CAUTION = 0.5
#: Characters that are decoded at once, and those read beyond on either side.
WINDOW, MARGIN = 150_000, 2_000
#: Rows of one segment from which its joins are salted.
HOT_ROWS = 50_000
BITS = 18
#: A token whose score outside any span leads all others by this much, as does the next one's, ends a sequence.
QUIET = 9.0
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
PRIMES = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


def _column(no: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), (no * 0x9E3779B9 + 0x7F4A7C15) & 0xFFFFFFFF, np.uint32)
    for p, k in zip(parts, PRIMES):
        h = (h ^ p) * k
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


class Lexicon:
    """What the vocabularies of public tokenizers tell of a word: how early its lower-case and its capitalised form come in them, and of how
    many pieces a word is that they lack. Everyday words are early in lower case, proper names only capitalised, invented words in pieces."""

    NAMES = ("byte_bpe_50k", "byte_bpe_multi_50k")
    STEPS = (4000, 15000, 60000)

    def __init__(self, folder: str = TOKENIZER_DIR) -> None:
        self.folder = folder

    def _place(self, word: bytes) -> int:
        """0 (early) to 3 (absent)."""
        rank = min(load_encoding(n, self.folder)._mergeable_ranks.get(word, 10**9) for n in self.NAMES)
        return int(np.searchsorted(self.STEPS, rank))

    def __call__(self, low: str) -> int:
        raw = " " + low
        lower, upper = self._place(raw.encode("utf-8", "surrogatepass")), self._place((" " + low.capitalize()).encode("utf-8", "surrogatepass"))
        pieces = 1 if lower < 3 else min(len(load_encoding(self.NAMES[0], self.folder).encode_ordinary(raw.encode("utf-8", "replace").decode())), 4)
        return 1 + lower + 4 * upper + 16 * (pieces - 1)


def common_words(folder: str = TOKENIZER_DIR, most: int = 9000) -> list[str]:
    """Lower-case words that are early pieces of the public vocabularies."""
    out: set[str] = set()
    for name in Lexicon.NAMES:
        ranks = load_encoding(name, folder)._mergeable_ranks
        out |= {w for k, r in ranks.items() if r < most and k[:1] == b" " and (w := k[1:].decode("utf-8", "ignore")).isalpha() and w.islower() and len(w) > 3}
    return sorted(out)


class Tokens:
    """Attributes of token kinds, remembered by token."""

    SIZE = 10

    def __init__(self, words: frozenset[str], given: frozenset[str], family: frozenset[str], lexicon: Lexicon) -> None:
        self.words, self.given, self.family, self.lexicon = words, given, family, lexicon
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows: list[tuple[int, ...]] = []

    def describe(self, t: str) -> tuple[int, ...]:
        low = t.lower()
        h = lambda s: xxhash.xxh32_intdigest(s.encode("utf-8", "surrogatepass"))
        lex = known = 0
        if t[0].isdigit():
            plain = shape = f"d{min(len(t), 11)}"
            ends = ("", "", "")
        elif t[0].isalpha():
            size = str(len(t)) if len(t) < 4 else "4"
            case = "X" if t.isupper() else "x" if t.islower() else "Xx" if t[0].isupper() and t[1:].islower() else "mX"
            shape, plain = case + size, "a" + size
            ends = (low[-3:], low[-4:], low[-6:]) if len(t) > 4 else (low, low, low)
            lex = self.lexicon(low)
            known = (low in self.given) + 2 * (low in self.family)
        else:
            plain = shape = t
            ends = ("", "", "")
        word = h(low) if low in self.words else 0
        # the gist of a token: its shape for digits and signs, what the lexicon tells and the case for words
        gist = h(f"{case}{min(len(t), 3)}/{lex}/{known}") if lex else h(shape)
        return word, h(shape), h(plain), known, *(h(e) for e in ends), lex, gist, int(t[0].isalnum())

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(attributes tokens x SIZE, starts, stops, tokens per text); the space before a token is part of its shapes."""
        if len(self.rows) > 500_000:
            self.clear()
        kinds: list[int] = []
        starts: list[int] = []
        stops: list[int] = []
        lengths = np.zeros(len(texts), np.int64)
        known = self.known
        for i, t in enumerate(texts):
            n = len(kinds)
            for m in TOKEN.finditer(t):
                w = m.group()
                k = known.get(w)
                if k is None:
                    k = known[w] = len(self.rows)
                    self.rows.append(self.describe(w))
                kinds.append(k)
                a, b = m.span()
                starts.append(a)
                stops.append(b)
            lengths[i] = len(kinds) - n
        a = np.array(self.rows, np.uint32).reshape(-1, self.SIZE)[np.array(kinds, np.int64)]
        s, e = np.array(starts, np.int64), np.array(stops, np.int64)
        if len(s):
            first = np.zeros(len(s), bool)
            first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
            spaced = np.ones(len(s), bool)
            spaced[1:] = s[1:] > e[:-1]
            spaced |= first
            a = a.copy()
            a[:, 1] = a[:, 1] * np.uint32(2) + spaced
            a[:, 2] = a[:, 2] * np.uint32(2) + spaced
            # whether a run of letters and digits goes on across the token's ends
            glued = a[:, 9].astype(bool) & ~spaced
            glued[1:] &= a[:-1, 9].astype(bool)
            a[:, 9] += np.uint32(2) * glued
            a[:-1, 9] += np.uint32(4) * glued[1:]
        return a, s, e, lengths


def feature_indices(a: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(tokens x columns): hashed features of each token and its surroundings."""
    n = len(a)
    place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    size = np.repeat(lengths, lengths)

    def at(column: int, o: int) -> np.ndarray:
        if not o:
            return a[:, column]
        out = np.full(n, 0xABCDEF, np.uint32)
        ok = np.flatnonzero((place + o >= 0) & (place + o < size))
        out[ok] = a[ok + o, column]
        return out

    w = {o: at(0, o) for o in range(-3, 4)}
    s = {o: at(1, o) for o in range(-2, 3)}
    p = {o: at(2, o) for o in range(-4, 5)}
    g = {o: at(3, o) for o in range(-2, 3)}
    x = {o: at(7, o) for o in range(-1, 2)}
    q = {o: at(8, o) for o in range(-2, 3)}
    sets = [(w[o],) for o in range(-3, 4)] + [(s[o],) for o in range(-2, 3)] + [(g[o],) for o in (-1, 0, 1)] + [(x[o],) for o in (-1, 0, 1)]
    sets += [(at(4, 0),), (at(5, 0),), (at(6, 0),), (at(5, 1),), (at(5, -1),)]
    sets += [(w[-1], w[0]), (w[0], w[1]), (w[-2], w[-1]), (w[-1], s[0]), (s[0], w[1]), (w[-2], w[-1], p[0]), (w[-1], p[0], p[1])]
    sets += [(s[-1], s[0]), (s[0], s[1]), (p[-1], p[0], p[1]), (p[0], p[1], p[2]), (p[-2], p[-1], p[0]), (p[-2], p[-1], p[0], p[1], p[2])]
    sets += [(p[0], p[1], p[2], p[3], p[4]), (p[-4], p[-3], p[-2], p[-1], p[0]), (g[0], g[1], s[0]), (g[-1], g[0], s[0]), (g[0], p[1], g[2]), (g[-2], p[-1], g[0])]
    sets += [(p[0], p[1], p[2], p[3]), (p[-3], p[-2], p[-1], p[0]), (w[-2], p[0]), (w[-3], p[0]), (at(9, 0), p[0]), (at(9, -1), at(9, 0), at(9, 1), p[0])]
    sets += [(q[0],), (q[0], q[1]), (q[-1], q[0]), (q[-1], q[0], q[1]), (q[0], q[1], q[2]), (q[-2], q[-1], q[0]), (w[-1], q[0]), (q[0], w[1]), (q[0], s[1], q[2]), (q[-2], s[-1], q[0])]
    return np.stack([_column(i, *x) for i, x in enumerate(sets)], 1)


def literal_words(lines: list[str]) -> frozenset[str]:
    """The words that the field knows as such: those of the labelled table."""
    from lanternq.llm import pii_examples as X

    text = re.sub(r"\{\w+\}", " ", "\n".join(lines))
    lists = [*X.ROLES, *X.TEAMS, *X.THINGS, *X.DAYS, *X.MONTHS, *X.STREETS, "weg straße strasse str gasse platz allee straat laan gatan avenue boulevard chemin calle via avenida rua plaza rue du de la example test invalid org net com dot at old new east upper south great"]
    return frozenset(t.lower() for t in TOKEN.findall(text + " " + " ".join(lists)))


def label_tokens(spans: list[tuple[int, int, str]], starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Label numbers of the tokens of one text. A dot at the end of an address is outside it."""
    y = np.zeros(len(starts), np.int64)
    for a, b, kind in spans:
        i, j = np.searchsorted(starts, a), np.searchsorted(starts, b)
        base = 1 + 2 * KINDS.index(kind)
        y[i:j] = base + 1
        y[i] = base
    return y


class Model:
    """A trained field; finds (start, stop, kind) in texts."""

    def __init__(self, tokens: Tokens, weights: np.ndarray, trans: np.ndarray, caution: float = CAUTION) -> None:
        self.tokens, self.weights, self.trans, self.caution = tokens, weights, trans, caution

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Findings of each text. Texts beyond WINDOW characters are decoded in windows that overlap by MARGIN characters on both sides; a
        finding counts in the window in whose middle it begins, so memory is bounded and all of the text is read."""
        if max(map(len, texts), default=0) <= WINDOW:
            return self._decode(texts)
        owner, shift, pieces = [], [], []
        for i, t in enumerate(texts):
            for at in range(0, max(len(t), 1), WINDOW):
                owner.append(i)
                shift.append((at, max(at - MARGIN, 0)))
                pieces.append(t[max(at - MARGIN, 0) : at + WINDOW + MARGIN])
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        lo = 0
        while lo < len(pieces):
            hi, size = lo + 1, len(pieces[lo])
            while hi < len(pieces) and size + len(pieces[hi]) <= 2 * WINDOW:
                size += len(pieces[hi])
                hi += 1
            for k, got in enumerate(self._decode(pieces[lo:hi]), lo):
                at, base = shift[k]
                for a, b, kind in got:
                    mine = out[owner[k]]
                    if at <= a + base < at + WINDOW and (not mine or mine[-1][1] <= a + base):
                        mine.append((a + base, b + base, kind))
            lo = hi
        return out

    def _decode(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        a, s, e, n = self.tokens(texts)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not len(s):
            return out
        emit = np.zeros((len(s), len(LABELS)), np.float32)
        f = feature_indices(a, n)
        for c in range(f.shape[1]):
            emit += self.weights[f[:, c]]
        emit[:, 0] += self.caution
        owner = np.repeat(np.arange(len(texts)), n)
        y = crf.viterbi_between(emit, owner, self.trans, QUIET)
        begin = np.flatnonzero(y % 2 == 1)
        for i in begin:
            kind, j = y[i], i + 1
            while j < len(y) and y[j] == kind + 1 and owner[j] == owner[i]:
                j += 1
            if not a[i, 9] & 2 and not a[j - 1, 9] & 4:  # nothing begins or ends inside a run of letters and digits
                out[owner[i]].append((int(s[i]), int(e[j - 1]), KINDS[(kind - 1) // 2]))
        return out


def train_part(given: tuple[str, ...], family: tuple[str, ...], seed: int, per_line: int, folder: str, lines: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) of one field, trained on the table filled with one seed. A third of the list's names is kept from the feature,
    and some known words are hidden, so that the field learns to do without."""
    rng = np.random.default_rng(seed)
    keep = lambda names: frozenset(x.lower() for x in names if rng.random() < 0.67)
    learn = Tokens(literal_words(list(lines)), keep(given), keep(family), Lexicon(folder))
    examples = labelled_texts(seed, per_line, list(given), list(family), common_words(folder), list(lines), MIXED)
    a, s, e, n = learn([t for t, _ in examples])
    hide = np.repeat(rng.choice([0.0, 0.15, 0.5], len(n)), n) > rng.random(len(a))
    a[hide, 0] = 0
    ends = np.cumsum(n)
    y = np.concatenate([label_tokens(sp, s[i - k : i], e[i - k : i]) for (_, sp), i, k in zip(examples, ends, n)])
    allowed = np.ones((len(LABELS), len(LABELS)), bool)
    for j in range(2, len(LABELS), 2):  # an inner label follows its own kind only
        allowed[:, j] = False
        allowed[[j - 1, j], j] = True
    return crf.train(feature_indices(a, n), y, n, len(LABELS), 1 << BITS, allowed)


def mean_model(parts: list[tuple[np.ndarray, np.ndarray]], given: tuple[str, ...], family: tuple[str, ...], folder: str, lines: tuple[str, ...]) -> Model:
    """The field whose weights are the means of the parts'."""
    weights, trans = (np.mean([p[i] for p in parts], axis=0).astype(np.float32) for i in (0, 1))
    lower = lambda names: frozenset(x.lower() for x in names)
    return Model(Tokens(literal_words(list(lines)), lower(given), lower(family), Lexicon(folder)), weights, trans)


_trained: dict[tuple, Model] = {}


def train_model(spark: SparkSession | None, given: tuple[str, ...] = (), family: tuple[str, ...] = (), parts: int | None = None, per_line: int | None = None, folder: str = TOKENIZER_DIR, lines: tuple[str, ...] | None = None) -> Model:
    """The field, trained on the labelled table (or the given lines of it): `parts` fields see the table filled with different values, one
    Spark task each (in this process without a session), and their weights are averaged. Kept for the process."""
    lines = lines or tuple(table_lines(LABELLED) + table_lines(RESEMBLING))
    parts, per_line = parts or PARTS, per_line or PER_LINE
    key = (given, family, parts, per_line, folder, lines)
    if key in _trained:
        return _trained[key]
    if spark is None:
        got = [train_part(given, family, seed, per_line, folder, lines) for seed in range(parts)]
    else:

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for seed in f["id"]:
                    w, trans = train_part(given, family, int(seed), per_line, folder, lines)
                    used = np.flatnonzero(w.any(1)).astype(np.int32)
                    yield pd.DataFrame({"used": [used.tobytes()], "weights": [w[used].tobytes()], "trans": [trans.tobytes()]})

        def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w, trans = np.zeros((1 << BITS, len(LABELS)), np.float32), np.zeros((len(LABELS), len(LABELS)), np.float32)
            for f in frames:
                for used, weights, t in zip(f["used"], f["weights"], f["trans"]):
                    w[np.frombuffer(used, np.int32)] += np.frombuffer(weights, np.float32).reshape(-1, len(LABELS))
                    trans += np.frombuffer(t, np.float32).reshape(len(LABELS), -1)
            for i in range(0, len(w), 1 << 15):
                yield pd.DataFrame({"at": [i], "weights": [(w[i : i + (1 << 15)] / parts).tobytes()], "trans": [(trans / parts).tobytes()]})

        each = spark.range(0, parts, 1, parts).mapInPandas(work, "used binary, weights binary, trans binary")
        w, trans = np.zeros((1 << BITS, len(LABELS)), np.float32), None
        for r in each.repartition(1).mapInPandas(merge, "at int, weights binary, trans binary").toLocalIterator():  # one model, in pieces
            block = np.frombuffer(bytes(r["weights"]), np.float32).reshape(-1, len(LABELS))
            w[r["at"] : r["at"] + len(block)] = block
            trans = np.frombuffer(bytes(r["trans"]), np.float32).reshape(len(LABELS), -1)
        got = [(w, trans)]
    _trained[key] = mean_model(got, given, family, folder, lines)
    return _trained[key]


def name_features(names: DataFrame | None) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Given and family names of a list (name_text, name_kind), at most MAX_NAMES distinct rows, else it is refused."""
    if names is None:
        return (), ()
    rows = names.filter("name_text is not null").select("name_text", "name_kind").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names")
    pick = lambda kind: tuple(sorted(r["name_text"] for r in rows if r["name_kind"] == kind))
    return pick("given"), pick("family")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def hot_segments(cut: DataFrame) -> DataFrame:
    """(h__, g__, parts__) of the segments with at least HOT_ROWS rows, at most 1,000 of them: what exceeds a thousandth of all rows is among them."""
    top = cut.groupBy("h__", "g__").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "h__", "g__").limit(1000).collect()
    rows = [(r["h__"], r["g__"], -(-r["n"] // HOT_ROWS)) for r in top if r["n"] >= HOT_ROWS]
    return F.broadcast(cut.sparkSession.createDataFrame(rows, "h__ bigint, g__ bigint, parts__ int"))


def join_findings(cut: DataFrame, found: DataFrame, hot: DataFrame, salt: Column, how: str) -> DataFrame:
    """cut joined with the findings of its segments; the rows of hot segments are spread over parts, to each of which their findings go."""
    on = ["h__", "g__"]
    part = cut.join(hot, on, "left").withColumn("s__", F.coalesce(F.pmod(F.xxhash64(salt), "parts__"), F.lit(0))).drop("parts__")
    spread = found.join(hot, on, "left").withColumn("s__", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts__", F.lit(1)).cast("bigint") - 1))).drop("parts__")
    return part.join(spread, [*on, "s__"], how).drop("s__")


def segment_keys(df: DataFrame) -> DataFrame:
    """df with 128 bits, as two numbers, that identify the segment seg__."""
    return df.withColumn("h__", F.xxhash64("seg__")).withColumn("g__", F.xxhash64(F.lit(7), F.reverse("seg__"), F.length("seg__")))


def segment_findings(texts: DataFrame, model: Model, text: str = "t__") -> tuple[DataFrame, DataFrame]:
    """(findings, segments): findings (h__, g__, found__ array<struct<pii_kind, pii_text>>, clean__) of those distinct segments that
    hold something; segments: texts with pos__ and the keys of each segment."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    cut = texts.filter(F.col(text).isNotNull() & (F.col(text) != "")).select("*", F.posexplode(F.split(text, SEPARATOR)).alias("pos__", "seg__")).drop(text)
    cut = segment_keys(cut)

    def once(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for f in frames:
            f = f.drop_duplicates(["h__", "g__"])
            keys = list(zip(f["h__"], f["g__"]))
            f = f[[k not in seen for k in keys]]
            if len(seen) < 1_000_000:
                seen.update(keys)
            yield f

    kinds = "h__ bigint, g__ bigint, seg__ string"
    distinct = cut.select("h__", "g__", "seg__").mapInPandas(once, kinds).repartition("h__").mapInPandas(once, kinds)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for f in frames:
            size = f["seg__"].str.len().to_numpy()
            lo = 0
            while lo < len(f):
                hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), 150_000)))
                segs = f["seg__"].iloc[lo:hi].tolist()
                got = m.find(segs)
                hit = [i for i, g in enumerate(got) if g]
                if hit:
                    yield pd.DataFrame({
                        "h__": f["h__"].iloc[lo:hi].to_numpy()[hit],
                        "g__": f["g__"].iloc[lo:hi].to_numpy()[hit],
                        "found__": [[{"pii_kind": k, "pii_text": segs[i][a:b]} for a, b, k in got[i]] for i in hit],
                        "clean__": [redact(segs[i], got[i]) for i in hit],
                    })
                lo = hi

    schema = "h__ bigint, g__ bigint, found__ array<struct<pii_kind:string,pii_text:string>>, clean__ string"
    return materialize(distinct.mapInPandas(decode, schema), "findings"), cut


def find_pii(texts: DataFrame, keys: list[str], text: str, names: DataFrame | None = None) -> DataFrame:
    """(keys..., pii_kind, pii_text), distinct."""
    src = texts.select(*keys, F.col(text).alias("t__")).dropna(subset=keys)
    found, cut = segment_findings(src, train_model(texts.sparkSession, *name_features(names)))
    rows = join_findings(cut.select(*keys, "h__", "g__"), found.select("h__", "g__", "found__"), hot_segments(cut), F.struct(*keys), "inner")
    return rows.select(*keys, F.explode("found__").alias("f__")).select(*keys, "f__.*").distinct()


def redact_column(texts: DataFrame, keys: list[str], text: str, names: DataFrame | None = None) -> DataFrame:
    """(keys..., redacted): the text of each row with typed placeholders such as [EMAIL]; null texts stay null. Rows without findings
    pass through where they lie (a filter of fixed size over the segments with findings tells), only the others are shuffled."""
    src = texts.select(*keys, F.col(text).alias("t__")).dropna(subset=keys)
    found, cut = segment_findings(src, train_model(texts.sparkSession, *name_features(names)))
    bits = H.filter_bits(found.count())
    seen = texts.sparkSession.sparkContext.broadcast(H.bit_filter(found, "h__", bits))
    cutter = re.compile(SEPARATOR)

    def flag(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            hit = np.zeros(len(f), bool)
            for i, t in enumerate(f["t__"]):
                if t:
                    h = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), seed=42) for s in cutter.split(t)]  # as Spark's xxhash64
                    hit[i] = H.in_filter(seen.value, H.bucket_of(np.array(h, H.U64), bits)).any()
            yield f.assign(hit__=hit)

    kinds = dict(src.dtypes)
    flagged = src.mapInPandas(flag, ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "t__"]) + ", hit__ boolean")
    rest = flagged.filter("hit__").select(*keys, F.xxhash64("t__").alias("id__"), F.posexplode(F.split("t__", SEPARATOR)).alias("pos__", "seg__"))
    parts = join_findings(segment_keys(rest), found.select("h__", "g__", "clean__"), hot_segments(cut), F.struct(*keys), "left").select(*keys, "id__", "pos__", F.coalesce("clean__", "seg__").alias("seg__"))
    whole = F.expr("array_join(transform(array_sort(collect_set(struct(pos__, seg__))), x -> x.seg__), '\n')")
    joined = parts.groupBy(*keys, "id__").agg(whole.alias("redacted"), F.count_if(F.col("pos__") == 0).alias("rows__"))
    joined = joined.withColumn("copy__", F.explode(F.sequence(F.lit(1), F.col("rows__"))))  # repeated rows stay repeated
    return flagged.filter("not hit__").select(*keys, F.col("t__").alias("redacted")).unionByName(joined.select(*keys, "redacted"))

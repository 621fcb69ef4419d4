"""Quality rules: base counts of a text, and a linear-chain conditional random field that labels its lines.

Viterbi decoding marks each line content or boilerplate; the share of a text's words that stand in content lines decides
whether it stays. The field is fitted on a bounded sample of documents labelled for quality. Labels are of documents and
the field is of lines, so line targets are estimated: at first the lines of good documents are content, but for those that
recur among other lines in other documents, and the lines of low ones are boilerplate; then, in a few rounds, lines take the
label that the field (in the first round without moves) finds likelier, as long as most words of a good document stay content and most of a low one don't.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideguard.llm.common import arrow_map, quoted, table, utf8, without

#: Labelled documents that are fitted at most, drawn by a hash of the id; lines of a training window; windows of a document
#: that are fitted at most, drawn by its checksum. So at most FIT_ROWS * MOST_WINDOWS * WINDOW lines are fitted.
FIT_ROWS, WINDOW, MOST_WINDOWS = 6_000, 32, 2
#: A line recurs if so many fitted documents hold it, with so many different lines around it.
RECURS = 3
#: Rounds of fitting, and steps of a round.
ROUNDS, STEPS, RATE, DECAY = 3, 40, 0.1, 1e-4
#: A text is kept if at least this share of its words is in content lines.
CONTENT = 0.5
SYMBOL = re.compile(rb"[#*$%&|<>]")
# Bounds of the features' steps: words, letters a word, symbols a word, share of upper-case words, exclamation marks a
# word, share of distinct words in lines of 8 words or more, share of words that are numbers.
STEPS_OF = ((1, 3, 8, 20, 60), (3, 4.5, 6, 8, 11), (0, 0.02, 0.1, 0.3), (0, 0.1, 0.3, 0.7), (0, 0.05, 0.3), (0.2, 0.4, 0.6, 0.8), (0, 0.2))
ENDS = (b".", b"!", b"?", b":", b'"')
#: Where each feature's one-hot weights begin; the last three features are short line, ends with a stop, repeats a line.
SIZES = (*[len(s) + 1 for s in STEPS_OF], 2, 2, 2)
OFFSETS = tuple(np.r_[0, np.cumsum(SIZES)[:-1]].tolist())
N_FEATURES = sum(SIZES)


@dataclass
class Field:
    """weights: of each feature for content against boilerplate; moves[a, b]: from label a to b; 1 is content."""

    weights: np.ndarray
    moves: np.ndarray


def line_features(line: bytes, words: list[bytes], repeated: bool) -> list[int]:
    """The positions of a line's active features; the line has a word."""
    n = len(words)
    short = n < 8
    measured = (
        n,
        sum(map(len, words)) / n,
        len(SYMBOL.findall(line)) / n,
        sum(map(bytes.isupper, words)) / n,
        line.count(b"!") / n,
        1.0 if short else len(set(words)) / n,
        sum(map(bytes.isdigit, words)) / n,
    )
    found = [o + bisect_left(s, x) for o, s, x in zip(OFFSETS, STEPS_OF, measured)]
    return [*found, OFFSETS[7] + short, OFFSETS[8] + line.rstrip().endswith(ENDS), OFFSETS[9] + repeated]


def lines_of(data: bytes) -> tuple[list[tuple[bytes, list[bytes], bool]], int]:
    """The lines that have a word, with their words and whether an earlier line equals them; how many do."""
    seen: set[bytes] = set()
    found, dup = [], 0
    for line in data.split(b"\n"):
        if words := line.split():
            again = line in seen
            dup += again
            seen.add(line)
            found.append((line, words, again))
    return found, dup


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, covered = 0, 0  # covered: the first word not yet counted
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def viterbi(field: Field, features: list[list[int]]) -> list[int]:
    """The likeliest labels of a text's lines."""
    if not features:
        return []
    emit = field.weights[np.array(features)].sum(axis=1).tolist()
    (m00, m01), (m10, m11) = field.moves.tolist()
    s0, s1 = 0.0, emit[0]
    back = []
    for e in emit[1:]:
        from0, from1 = s1 + m10 > s0 + m00, s1 + m11 > s0 + m01
        s0, s1 = max(s0 + m00, s1 + m10), max(s0 + m01, s1 + m11) + e
        back.append((from0, from1))
    label = int(s1 > s0)
    labels = [label]
    for choice in reversed(back):
        label = int(choice[label])
        labels.append(label)
    return labels[::-1]


def measure(data: bytes, field: Field) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, share of words in content lines (0 without words)."""
    lines, dup = lines_of(data)
    words = [w for _, own, _ in lines for w in own]
    n = len(words)
    spaces = len(data) - sum(map(len, words))  # every byte outside words is white space
    labels = viterbi(field, [line_features(*x) for x in lines])
    content = sum(len(own) for (_, own, _), y in zip(lines, labels, strict=True) if y)
    return n, len(data.decode("utf-8", "replace")) - spaces, len(SYMBOL.findall(data)), dup, repeat_words(words), content / n if n else 0.0


def chosen_windows(n: int, data: bytes) -> list[tuple[int, int]]:
    """Bounds of the windows of a text's n lines that are fitted: all, or MOST_WINDOWS drawn by its checksum."""
    count = -(-n // WINDOW)
    at = range(count) if count <= MOST_WINDOWS else sorted(random.Random(crc32(data)).sample(range(count), MOST_WINDOWS))
    return [(i * WINDOW, min(n, (i + 1) * WINDOW)) for i in at]


def recurring(windows: list[list[int]], doc_of: list[int]) -> set[int]:
    """Hashes of lines that at least RECURS documents hold, with as many different pairs of neighbours. Copies of a document
    repeat its lines with the same neighbours, so they don't make its lines recur."""
    around, docs = defaultdict(set), defaultdict(set)
    for hashes, d in zip(windows, doc_of, strict=True):
        for before, own, after in zip([0, *hashes], hashes, [*hashes[1:], 0]):
            around[own].add((before, after))
            docs[own].add(d)
    return {h for h, x in around.items() if len(x) >= RECURS and len(docs[h]) >= RECURS}


class Lines:
    """The fitted windows as arrays: features, mask, words, whether a line recurs, and the document of each window."""

    def __init__(self, rows: list[dict]):
        cut = [(r, i, d) for d, r in enumerate(rows) for i in range(len(r["sizes"]))]
        shape = (len(cut), WINDOW)
        self.x = np.zeros((*shape, len(SIZES)), np.int32)
        self.mask, self.words, self.recurs = np.zeros(shape, bool), np.zeros(shape), np.zeros(shape, bool)
        self.doc_of = np.array([d for *_, d in cut], np.int64)
        self.good = np.array([r["y"] for r in rows], bool)
        hashes = []
        for w, (r, i, _) in enumerate(cut):
            lo = sum(r["sizes"][:i])
            hi = lo + r["sizes"][i]
            self.x[w, : hi - lo], self.words[w, : hi - lo], self.mask[w, : hi - lo] = r["lines"][lo:hi], r["words"][lo:hi], True
            hashes.append(r["hashes"][lo:hi])
        length = self.mask.sum(axis=1)
        # windows of similar length, cut to the longest of them
        groups = [(np.flatnonzero((length > least) & (length <= n)), n) for least, n in ((0, 2), (2, 4), (4, 8), (8, 16), (16, WINDOW))]
        self.parts = [(at, n, self.x[at, :n], self.mask[at, :n]) for at, n in groups if len(at)]
        found = recurring(hashes, self.doc_of.tolist())
        for w, own in enumerate(hashes):
            self.recurs[w, : len(own)] = [h in found for h in own]

    def first_targets(self) -> np.ndarray:
        return self.mask & self.good[self.doc_of][:, None] & ~self.recurs

    def targets(self, content: np.ndarray) -> np.ndarray:
        """Targets by the probability of content: the likelier label, but recurring lines are boilerplate, and documents whose
        share of content words contradicts their label change the lines that are nearest to the other label."""
        y = self.mask & ~self.recurs & (content > 0.5)
        n = len(self.good)
        total = np.bincount(self.doc_of, self.words.sum(axis=1), n)
        inside = np.bincount(self.doc_of, (self.words * y).sum(axis=1), n)
        wrong = self.good != (inside >= CONTENT * total)
        for d in np.flatnonzero(wrong):
            own = np.flatnonzero(self.doc_of == d)
            free = np.argwhere(self.mask[own] & (~self.recurs[own] & ~y[own] if self.good[d] else y[own]))
            at = own[free[:, 0]], free[:, 1]
            order = np.argsort(-content[at] if self.good[d] else content[at], kind="stable")
            for w, t in zip(at[0][order], at[1][order], strict=True):
                if self.good[d] == (inside[d] >= CONTENT * total[d]):
                    break
                y[w, t] = self.good[d]
                inside[d] += self.words[w, t] if self.good[d] else -self.words[w, t]
        return y


def gradient(params: np.ndarray, lines: Lines, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log-likelihood of targets y, by forward-backward sums; and the probability of content of each line."""
    moves = params[N_FEATURES:].reshape(2, 2)
    grad, content = np.zeros_like(params), np.zeros(lines.mask.shape)
    for at, n, x, mask in lines.parts:
        target, pairs = y[at, :n], mask[:, 1:]
        emit = params[x].sum(axis=2)
        e = np.stack([np.zeros(mask.shape), emit], axis=2)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, n):
            go = np.logaddexp(forward[:, t - 1, :1] + moves[0], forward[:, t - 1, 1:] + moves[1]) + e[:, t]
            forward[:, t] = np.where(mask[:, t, None], go, forward[:, t - 1])
        for t in range(n - 2, -1, -1):
            ahead = e[:, t + 1] + backward[:, t + 1]
            go = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
            backward[:, t] = np.where(mask[:, t + 1, None], go, backward[:, t + 1])
        norm = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        likely = np.exp(forward[:, :, 1] + backward[:, :, 1] - norm[:, None]) * mask
        content[at, :n] = likely
        grad[:N_FEATURES] += np.bincount(x.reshape(-1), np.repeat((likely - target).reshape(-1), len(SIZES)), N_FEATURES)
        for a in (0, 1):
            for b in (0, 1):
                joint = np.exp(forward[:, :-1, a] + moves[a, b] + e[:, 1:, b] + backward[:, 1:, b] - norm[:, None]) * pairs
                seen = (target[:, :-1] == a) & (target[:, 1:] == b) & pairs
                grad[N_FEATURES + 2 * a + b] += joint.sum() - seen.sum()
    return grad / lines.mask.sum() + DECAY * params, content


def fit_field(rows: list[dict]) -> Field:
    """Maximum likelihood with Adam, in rounds between which targets are estimated anew. rows: y, lines (their features), hashes,
    words and sizes of windows. All lines are content without labels of both kinds."""
    rows = [r for r in rows if r["sizes"]]
    if len({r["y"] for r in rows}) < 2:
        return Field(np.full(N_FEATURES, 1.0), np.zeros((2, 2)))
    lines = Lines(rows)
    y = lines.first_targets()
    params = np.zeros(N_FEATURES + 4)
    for round_ in range(ROUNDS):
        m, s = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, STEPS + 1):
            grad, content = gradient(params, lines, y)
            if not round_:  # at first each line by itself, as the targets of a document don't yet differ
                grad[N_FEATURES:] = 0
            m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
            params = params - RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        y = lines.targets(content)
    return Field(params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> Field:
    """Fit the field on at most about fit_rows labelled documents. Several labels of one id count as the smallest; of rows that
    repeat an id the one with the least hash, then text, is fitted, so the field doesn't depend on the order of rows."""
    known = labels.where(quoted(label).isNotNull() & quoted(id_col).isNotNull())
    known = known.groupBy(quoted(id_col).alias("__id")).agg(F.min((quoted(label) > 0).cast("int")).alias("y"))
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / n))
    # known has about fit_rows short rows at most, so it may be broadcast
    rows = docs.select(quoted(id_col).alias("__id"), utf8(text).alias("data")).join(F.broadcast(known), "__id")
    rows = rows.groupBy("__id").agg(F.min(F.struct(F.xxhash64("data"), "data", "y")).alias("first")).select("first.data", "first.y")

    def start():
        import xxhash

        def one(data):
            found, _ = lines_of(data)
            cuts = chosen_windows(len(found), data)
            own = [x for lo, hi in cuts for x in found[lo:hi]]
            return [line_features(*x) for x in own], [xxhash.xxh64_intdigest(x) - (1 << 63) for x, _, _ in own], [len(w) for _, w, _ in own], [hi - lo for lo, hi in cuts]

        return lambda values: [list(c) for c in zip(*map(one, values), strict=True)] or [[]] * 4

    got = arrow_map(rows, [F.col("data")], "lines array<array<int>>, hashes array<bigint>, words array<int>, sizes array<int>", start, ["y"])
    return fit_field(sorted(got.toArrow().to_pylist(), key=lambda r: (r["y"], r["hashes"], r["sizes"])))


def judge(docs: DataFrame, field: Field, *, text: str = "text", content: float = CONTENT, keep: list[str] | None = None) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share and kept.

    A null text has no words and fails the base rule, as does every text of under 50 words. Rows are neither merged nor dropped;
    texts are read whole; columns named as an output are replaced; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)  # a few dozen numbers

    def start():
        own = sent.value

        def compute(values):
            rows = [measure(v, own) for v in values]
            failed = [r[0] < 50 or 100 * r[4] > 50 * r[0] for r in rows]
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
            return [*columns[:5], failed, columns[5], [not f and r[5] >= content for f, r in zip(failed, rows, strict=True)]]

        return compute

    outputs = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, kept boolean"
    return arrow_map(docs, [utf8(text)], outputs, start, without(docs, []) if keep is None else keep)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])

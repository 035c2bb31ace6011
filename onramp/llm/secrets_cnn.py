"""Operator 6: secret scan with a character convolutional network.

Base findings are the matches of three fixed patterns (kinds assign, access, hex); they
always stay. Candidates are all runs of ``RUN`` or more characters of a secret's alphabet,
and the value of every base finding of kind assign or access. A network in numpy reads
windows of a fixed number of code points, of the candidate and around: one for up to
``BODY`` characters, else one every ``STEP`` characters and one at the end. The largest
score of its windows, in training, calibration and scan, is the candidate's; a
run that base findings do not cover wholly and that scores at or above the threshold is
added, from end to end, as a span of kind ``model``.

Labelled findings: a candidate that overlaps an assign or access finding is positive, one
that overlaps no base finding negative; runs found as hex alone are left out. Training,
calibration and threshold read all different candidates of both labels with all their windows.
They are dealt out by hash to parts of about ``PART_FINDINGS``, so a part has the same size at
any size of the corpus; of a label too rare for that, every finding goes to several parts, so
that each has some ``LEAST`` or all of them. In each of ``EPOCHS`` passes every part carries the
common network on by steps over its own samples, and the mean of what the parts come to
(parameters and the optimiser's moments) is the next common network.

The patterns find keys of few kinds, so every finding is varied in ways that keep its label, a
label of a part up to ``VARIED`` samples, or half as many again as it has findings: a secret's
characters are drawn anew from one of ``ALPHABETS`` in a length of its own
and stand in its own surroundings, in those of a negative, or in none; a negative is put
in capitals, or joined with others by the signs of paths and names. In training the
surroundings of half the samples are blanked besides. Scores come from ``FOLDS``-fold
cross-validation (a finding and its variants in one fold, by hash), which calibrates them
(temperature and shift) and sets the threshold: the highest one that still finds ``RECALL``
of the positives with their surroundings blanked, which of all such thresholds has the
fewest false alarms. The share found is kept in ``recall``, the negatives' share above it in
``alarms``; a threshold under ``FLOOR`` is warned of, not raised. The network of the scan is
fitted to all samples, beside those of the folds.

Spans are code points, end exclusive. Runs are found without backtracking on a byte mask
of the text in which every other character is one byte, so positions are code points.

Edge cases: null is the empty text; a text without findings has empty ``spans`` and the
sha256 of the empty string; without labels of both kinds nothing is added; equal windows
score alike, so repeated rows get equal spans; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
import warnings
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onramp.session import materialize

from .common import packed, pick, strings, table, unpacked

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex")

RUN = 16
BEFORE, BODY, AFTER = 20, 36, 8
WINDOW = BEFORE + BODY + AFTER
STEP = BODY // 3
BAG = 64               # windows that ``sampled`` shows of one candidate; training and scan read all
PART_FINDINGS, PART_BYTES = 4096, 1 << 22  # of a part, about
LEAST = 64             # findings of a label in a part, if there are as many
VARIED = 3000          # samples a label in a part, with variants
FOLDS = 3
ALPHABETS = tuple(a.encode() for a in (
    string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_",
    string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, string.digits + "ABCDEF", string.digits + "abcdef"))
KEY_LENGTHS = (16, 40)
RECALL = 0.99
FLOOR = 0.5
EMBED, FILTERS, WIDTH, EPOCHS = 8, 24, 5, 8
AT_ONCE = 2048
BLOCK = 512            # numbers of a network in one row
TEMPERATURES, SHIFTS = (a.ravel() for a in np.meshgrid(np.exp(np.linspace(np.log(0.3), np.log(10), 30)), np.linspace(-8, 8, 65), indexing="ij"))
UNIT = 1 << 20         # losses are added up as whole numbers of 1 / UNIT, so their order does not matter
MARK = "<secret>"

HEX_MASK = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))
RUN_MASK = bytes(1 if c < 128 and (chr(c).isalnum() or chr(c) in "+/_=-") else 0 for c in range(256))
HINTS = ("passw", "secret", "token", "apikey", "api_key")


def masked_runs(raw: bytes, mask: bytes, least: int) -> list[tuple[int, int]]:
    """Maximal runs of the mask's characters with ``least`` or more of them."""
    bits, need, out, at = raw.translate(mask), b"\x01" * least, [], 0
    while (s := bits.find(need, at)) >= 0:
        e = bits.find(b"\0", s + least)
        at = e if e >= 0 else len(bits)
        out.append((s, at))
    return out


def base_findings(text: str, raw: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value), sorted. ``raw`` has a byte a code point."""
    out = []
    low = raw.lower()
    if any(h.encode() in low for h in HINTS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(s, 2, e, s) for s, e in masked_runs(raw, HEX_MASK, HEX_LEAST)]
    return sorted(out)


def starts(s: int, e: int) -> list[int]:
    """Where the windows of a candidate start: all of it lies in one of them, the last at its end."""
    return [*range(s, e - BODY, STEP), max(s, e - BODY)]


def window(raw: bytes, a: int, e: int) -> bytes:
    """``WINDOW`` bytes: before, the candidate's characters from ``a`` on, after."""
    b = min(e, a + BODY)
    return raw[max(0, a - BEFORE):a].rjust(BEFORE, b"\0") + raw[a:b].ljust(BODY, b"\0") + raw[b:b + AFTER].ljust(AFTER, b"\0")


def context(raw: bytes, s: int, e: int) -> bytes:
    """All that the windows of a candidate show: before, the candidate, after."""
    return raw[max(0, s - BEFORE):s].rjust(BEFORE, b"\0") + raw[s:e] + raw[e:e + AFTER].ljust(AFTER, b"\0")


def spread(shown: bytes) -> bytes:
    """The windows of a candidate, one after the other, from its context."""
    e = len(shown) - AFTER
    return b"".join(window(shown, a, e) for a in starts(BEFORE, e))


def sampled(windows: bytes) -> bytes:
    """At most ``BAG`` of a candidate's windows, the first and the last among them (to look at)."""
    n = len(windows) // WINDOW
    if n <= BAG:
        return windows
    return b"".join(windows[i * WINDOW:(i + 1) * WINDOW] for i in (j * (n - 1) // (BAG - 1) for j in range(BAG)))


def candidates(raw: bytes, base: list) -> list[tuple[int, int, int]]:
    """(start, end, label): 1 overlaps assign or access, 0 overlaps none, -1 hex alone."""
    out = []
    values = [(v, e) for _, kind, e, v in base if kind < 2]
    covered = []
    for s, e in masked_runs(raw, RUN_MASK, RUN):
        label = 1 if any(a < e and s < b for a, b in values) else -1 if any(a < e and s < b for a, _, b, _ in base) else 0
        out.append((s, e, label))
        covered.append((s, e))
    out += [(v, e, 1) for v, e in values if not any(a < e and v < b for a, b in covered)]
    return out


def beyond(s: int, e: int, base: list) -> bool:
    """Whether s..e holds a character outside all base findings (sorted by start)."""
    for a, _, b, _ in base:
        if a > s:
            break
        s = max(s, b)
    return s < e


class Scan:
    """Findings and candidates of one text."""

    def __init__(self, text: str | None) -> None:
        text = text or ""
        raw = text.encode("ascii", "replace")
        self.base = base_findings(text, raw)
        self.candidates = candidates(raw, self.base)
        self.contexts = [context(raw, s, e) for s, e, _ in self.candidates]

    @cached_property
    def windows(self) -> list[bytes]:
        """Of each candidate."""
        return list(map(spread, self.contexts))


# --- network ---------------------------------------------------------------------------

def _codes(windows: bytes) -> np.ndarray:
    return np.minimum(np.frombuffer(windows, np.uint8).reshape(-1, WINDOW), 127)


def varied(found: list[tuple[bytes, int]], seed: int = 17) -> list[tuple[bytes, int, int]]:
    """(windows, label, number of the finding) of all findings and their variants."""
    rng = np.random.default_rng(seed)
    out = [(w, label, i) for i, (w, label) in enumerate(found)]
    negatives = [(w, i) for i, (w, label) in enumerate(found) if label == 0]

    def sides(w: bytes) -> tuple[bytes, bytes]:
        return w[:BEFORE], w[-AFTER:]

    def around(key: bytes, before: bytes, after: bytes) -> bytes:
        return spread(before + key + after)

    def body(w: bytes) -> bytes:
        return w[BEFORE:BEFORE + BODY].rstrip(b"\0")

    for label in (0, 1):
        own = [(w, i) for i, (w, y) in enumerate(found) if y == label]
        for k in range(max(VARIED, 3 * len(own) // 2) - len(own) if own else 0):
            w, i = own[k % len(own)]
            other = negatives[rng.integers(len(negatives))][0] if negatives else w
            before, after = ((b"\0" * BEFORE, b"\0" * AFTER), sides(w), sides(other))[k // len(own) % 3]
            if label:
                alphabet = ALPHABETS[rng.integers(len(ALPHABETS))]
                key = bytes(rng.choice(np.frombuffer(alphabet, np.uint8), rng.integers(KEY_LENGTHS[0], KEY_LENGTHS[1] + 1)))
            else:
                sign = (b"/", b"-", b"_", b"", b"=")[rng.integers(5)]
                key = (body(w), body(w).upper(), body(w).capitalize() + body(other).capitalize(), body(w) + sign + body(other))[rng.integers(4)]
            out.append((around(key, before, after), label, i))
    return out


def blanked(windows: bytes) -> bytes:
    """Windows without what lies before and after the candidate."""
    return b"".join(b"\0" * BEFORE + windows[i + BEFORE:i + BEFORE + BODY] + b"\0" * AFTER for i in range(0, len(windows), WINDOW))


class CharNet:
    """Embedding, one convolution over the window with a channel for the candidate's place,
    the largest and the mean activation of each filter, logistic output."""

    def __init__(self, seed: int = 11) -> None:
        self.place = np.zeros(WINDOW)
        self.place[BEFORE:BEFORE + BODY] = 1
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 0.5, (128, EMBED)), rng.normal(0, 0.15, (WIDTH * (EMBED + 1), FILTERS)), np.zeros(FILTERS),
                  rng.normal(0, 0.2, 2 * FILTERS), np.zeros(1)]
        self.p[0][0] = 0
        self.m, self.v, self.step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0.0
        self.temperature, self.shift, self.threshold, self.recall, self.alarms = 1.0, 0.0, 1.0, float("nan"), float("nan")

    def state(self) -> np.ndarray:
        """Parameters, moments and number of steps as one vector."""
        return np.concatenate([a.ravel() for a in (*self.p, *self.m, *self.v)] + [[self.step]])

    def restore(self, state: np.ndarray) -> CharNet:
        at = 0
        for a in (*self.p, *self.m, *self.v):
            a[...] = state[at:at + a.size].reshape(a.shape)
            at += a.size
        self.step = float(state[at])
        return self

    def learn(self, windows: list[bytes], labels: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over the samples."""
        weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        outside = np.flatnonzero(self.place == 0)
        for part in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 64)):
            c, owner = _codes(b"".join(windows[i] for i in part)), np.repeat(np.arange(len(part)), [len(windows[i]) // WINDOW for i in part])
            blank = np.flatnonzero((rng.random(len(part)) < 0.5)[owner])
            c[np.ix_(blank, outside)] = 0
            if len(c) > len(part):  # of each candidate the window with the largest score is learned from
                several, z = np.bincount(owner)[owner] > 1, np.zeros(len(c))
                z[several] = self._outputs(c[several])
                order = np.lexsort((-z, owner))
                c = c[order[np.searchsorted(owner[order], np.arange(len(part)))]]
            z, cache = self._forward(c)
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[part]) * weight[part] / len(part)
            grads = self._backward(err, cache)
            self.step += 1
            for p, g, a, b in zip(self.p, grads, self.m, self.v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.004 * (a / (1 - 0.9**self.step)) / (np.sqrt(b / (1 - 0.999**self.step)) + 1e-8)
            self.p[0][0] = 0

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """``calibrate`` for scores in memory."""
        if not len(z):
            return
        self._choose(losses(z, y))
        found = np.sort(z[y == 1])
        if len(found):
            self._cut(found[missed(len(found))])
            over = self.calibrated(z) >= self.threshold
            self._report(over[y == 1].mean(), over[y == 0].mean() if (y == 0).any() else 0.0)

    def _choose(self, loss: np.ndarray) -> None:
        best = int(np.argmin(loss))
        self.temperature, self.shift = float(TEMPERATURES[best]), float(SHIFTS[best])

    def _cut(self, z: float) -> None:
        self.threshold = float(self.calibrated(z)) - 1e-9

    def _report(self, recall: float, alarms: float) -> None:
        self.recall, self.alarms = float(recall), float(alarms)
        if self.threshold < FLOOR:
            warnings.warn(f"secret scan: threshold {self.threshold:.3f} for a recall of {self.recall:.3f}", stacklevel=3)

    def _forward(self, codes: np.ndarray):
        n = len(codes)
        x = np.concatenate((self.p[0][codes], np.broadcast_to(self.place[:, None], (n, WINDOW, 1))), axis=2)
        cols = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - WIDTH + 1, -1)
        a = np.maximum(cols @ self.p[1] + self.p[2], 0)
        top = a.argmax(axis=1)
        pooled = np.concatenate((np.take_along_axis(a, top[:, None], axis=1)[:, 0], a.mean(axis=1)), axis=1)
        return pooled @ self.p[3] + self.p[4], (codes, cols, a, top, pooled)

    def _backward(self, err: np.ndarray, cache) -> list[np.ndarray]:
        codes, cols, a, top, pooled = cache
        n, length, _ = a.shape
        d = err[:, None] * self.p[3]
        da = np.broadcast_to(d[:, None, FILTERS:] / length, a.shape).copy()
        np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], axis=1) + d[:, None, :FILTERS], axis=1)
        da *= a > 0
        flat = da.reshape(-1, FILTERS)
        back = (flat @ self.p[1].T).reshape(n, length, WIDTH, EMBED + 1)[..., :EMBED]
        dx = np.zeros((n, WINDOW, EMBED))
        for w in range(WIDTH):
            dx[:, w:w + length] += back[:, :, w]
        embed = np.zeros_like(self.p[0])
        np.add.at(embed, codes.ravel(), dx.reshape(-1, EMBED))
        return [embed, cols.reshape(-1, cols.shape[2]).T @ flat, flat.sum(0), pooled.T @ err, np.array([err.sum()])]

    def _outputs(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i:i + AT_ONCE])[0] for i in range(0, len(codes), AT_ONCE)])

    def logits(self, windows: list[bytes]) -> np.ndarray:
        """The largest output of each candidate's windows."""
        if not windows:
            return np.zeros(0)
        z = self._outputs(_codes(b"".join(windows)))
        return np.maximum.reduceat(z, np.cumsum([0, *(len(w) // WINDOW for w in windows[:-1])]))

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z / self.temperature + self.shift, -40, 40)))

    def score(self, windows: list[bytes]) -> np.ndarray:
        return self.calibrated(self.logits(windows))


def missed(n: int) -> int:
    """How many of ``n`` positives the threshold may miss."""
    return int(np.floor((1 - RECALL) * n))


def losses(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The summed loss at each temperature and shift, in whole units."""
    out = np.zeros(len(SHIFTS), np.int64)
    for i in range(0, len(z), 64):
        at_odds = np.where(y[i:i + 64] == 1, -1, 1)[:, None] * (z[i:i + 64, None] / TEMPERATURES + SHIFTS)
        out += np.rint(np.logaddexp(0, at_odds) * UNIT).astype(np.int64).sum(axis=0)
    return out


def labelled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All different labelled candidates of all documents: context, label and fold."""
    def run(batches):
        for b in batches:
            got = [(w, c[2]) for t in strings(b, "text") for scan in [Scan(t)] for w, c in zip(scan.contexts, scan.candidates) if c[2] >= 0]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int32())], names=["context", "label"])

    found = pick(docs, text=text_col).filter("text IS NOT NULL").mapInArrow(run, "context binary, label int").distinct()
    return found.withColumn("fold", F.pmod(F.xxhash64("context"), F.lit(FOLDS)).cast("int"))


def dealt(found: DataFrame, counts: dict[int, int], size: int) -> DataFrame:
    """Every finding in its part (``home``), those of a rare label in others as well."""
    parts = max(1, math.ceil(sum(counts.values()) / PART_FINDINGS), math.ceil(size / PART_BYTES))
    times = F.lit(0)
    for label, n in counts.items():
        times = F.when(F.col("label") == label, min(parts, math.ceil(parts * LEAST / n))).otherwise(times)
    each = found.select("*", F.explode(F.sequence(F.lit(0), times - 1)).alias("copy"))
    part = F.pmod(F.xxhash64(F.lit(1), "context") + F.col("copy"), F.lit(parts)).cast("int")
    # as many tasks as parts: a pass is work for the processor, not for the disk
    return each.select("context", "label", "fold", (F.col("copy") == 0).alias("home"), part.alias("part")).repartition(parts, "part")


def samples(key: tuple, rows: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Windows, label, fold and whether at home of all findings of a part and their variants."""
    own = sorted(zip(*(rows.column(c).to_pylist() for c in ("label", "context", "fold", "home"))))
    out = varied([(spread(shown), label) for label, shown, *_ in own], 17 + key[0].as_py())
    fold, home = (np.array([own[i][k] for *_, i in out]) for k in (2, 3))
    return [w for w, *_ in out], np.array([y for _, y, _ in out], np.float64), fold, home


def carried_on(parts: DataFrame, nets: list[CharNet], epoch: int) -> None:
    """One pass of all networks over all samples. Network f leaves out fold f, the last none; the
    mean of what the parts come to takes its place, part by part in the order of their numbers."""
    spec = parts.sparkSession.sparkContext.broadcast([n.state() for n in nets])
    blocks = math.ceil(len(spec.value[0]) / BLOCK)

    def learn(key, rows):
        windows, labels, fold, _ = samples(key, rows)
        at, values = [], []
        for f, state in enumerate(spec.value):
            fit = np.flatnonzero(fold != f)
            if len(set(labels[fit].tolist())) == 2:
                net = CharNet().restore(state)
                net.learn([windows[i] for i in fit], labels[fit], np.random.default_rng((epoch, key[0].as_py())))
                new = net.state()
                at += range(f * blocks, (f + 1) * blocks)
                values += [new[i:i + BLOCK] for i in range(0, len(new), BLOCK)]
        return pa.table([pa.array(at, pa.int32()), pa.array([key[0].as_py()] * len(at), pa.int32()), pa.array(values, pa.list_(pa.float64()))], names=["at", "part", "values"])

    def mean(key, rows):
        order = np.argsort(rows.column("part").to_numpy())
        vectors = rows.column("values").to_pylist()
        total = np.zeros(len(vectors[0]))
        for i in order:
            total += vectors[i]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total / len(vectors)], pa.list_(pa.float64()))], names=["at", "values"])

    new = parts.groupBy("part").applyInArrow(learn, "at int, part int, values array<double>").groupBy("at").applyInArrow(mean, "at int, values array<double>")
    got = {r["at"]: r["values"] for r in new.collect()}
    for f, net in enumerate(nets):
        if f * blocks in got:
            net.restore(np.concatenate([got[f * blocks + i] for i in range(blocks)]))
    spec.unpersist()


def set_aside(parts: DataFrame, nets: list[CharNet]) -> DataFrame:
    """label and z of every sample, by the network that left its fold out: positives without their
    surroundings, negatives as they stand. A network without a pass (no label left) scores none."""
    spec = parts.sparkSession.sparkContext.broadcast([n.state() if n.step else None for n in nets])

    def run(key, rows):
        windows, labels, fold, home = samples(key, rows)
        y, z = [], []
        for f, state in enumerate(spec.value[:FOLDS]):
            aside = np.flatnonzero((fold == f) & home)
            if state is not None and len(aside):
                z.append(CharNet().restore(state).logits([blanked(windows[i]) if labels[i] else windows[i] for i in aside]))
                y.append(labels[aside])
        y, z = (np.concatenate([*a, []]) for a in (y, z))
        return pa.table([pa.array(y.astype(np.int32)), pa.array(z, pa.float64())], names=["label", "z"])

    return parts.groupBy("part").applyInArrow(run, "label int, z double")


def calibrate(net: CharNet, scores: DataFrame) -> None:
    """Temperature, shift, threshold, recall and alarms from all ``scores`` (label, z)."""
    def run(batches):
        total = np.zeros(len(SHIFTS), np.int64)
        for b in batches:
            total += losses(b.column("z").to_numpy(), b.column("label").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "loss"])

    n = {r.label: r.n for r in scores.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n:
        return
    summed = scores.mapInArrow(run, "at int, loss long").groupBy("at").agg(F.sum("loss").alias("loss"))
    net._choose(np.array([r.loss for r in sorted(summed.collect())]))
    if 1 in n:
        net._cut(scores.filter("label = 1").orderBy("z").offset(missed(n[1])).first().z)
        z = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("z") / net.temperature + net.shift))
        over = {r.label: r.n for r in scores.filter(1 / (1 + F.exp(-z)) >= net.threshold).groupBy("label").agg(F.count("*").alias("n")).collect()}
        net._report(over.get(1, 0) / n[1], over.get(0, 0) / n[0] if 0 in n else 0.0)


def train(docs: DataFrame, text_col: str = "text") -> CharNet | None:
    """The network, from all labelled candidates of all documents."""
    found = materialize(labelled(docs, text_col), "secret-findings")
    got = found.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("context")).alias("size")).collect()
    if len(got) < 2:
        return None
    parts = dealt(found, {r.label: r.n for r in got}, sum(r.size for r in got))
    nets = [CharNet() for _ in range(FOLDS + 1)]
    for epoch in range(EPOCHS):
        carried_on(parts, nets, epoch)
    calibrate(nets[-1], materialize(set_aside(parts, nets), "secret-scores"))
    return nets[-1]


def found_spans(scans: list[Scan], net: CharNet | None) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of each text: base findings and added runs, by start and kind."""
    scores = net.score([w for s in scans for w in s.windows]) if net else None
    out, at = [], 0
    for s in scans:
        own = [(a, k, e, KINDS[k]) for a, k, e, _ in s.base]
        for a, e, _ in s.candidates:
            if net and scores[at] >= net.threshold and beyond(a, e, s.base):
                own.append((a, len(KINDS), e, "model"))
            at += 1
        out.append([(a, e, kind) for a, _, e, kind in sorted(own)])
    return out


def joined(spans) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def scan(docs: DataFrame, net: CharNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts and hash of the base findings, and all spans of every row."""
    d = pick(docs, doc_id=id_col, text=text_col)
    spec = d.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers
    schema = T.StructType([d.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches):
        for b in batches:
            all_spans = found_spans([Scan(t) for t in strings(b, "text")], spec.value)
            base = [[x for x in own if x[2] != "model"] for own in all_spans]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array([sum(x[2] == k for x in own) for own in base], pa.int64()) for k in KINDS],
                 pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own in base], pa.string()),
                 pa.array(list(map(joined, all_spans)), pa.string())], names=schema.names)

    return d.mapInArrow(run, schema)


def hidden(text: str, spans) -> str:
    """``text`` with each found stretch replaced by the mark (overlaps merged)."""
    out, at, end = [], 0, -1
    for s, e, _ in spans:
        if s >= max(end, 0) or end < 0:
            out += [text[at:s], MARK]
            end = e
        else:
            end = max(end, e)
        at = end
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, net: CharNet | None) -> DataFrame:
    """The documents with found secrets replaced by a mark; n_chars follows the text."""
    d = packed(docs, text="text")
    spec = d.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            texts = strings(b, "text")
            new = [t if t is None else hidden(t, s) for t, s in zip(texts, found_spans([Scan(t) for t in texts], spec.value))]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(new, pa.string())], names=["row", "text"])

    out = d.mapInArrow(run, d.schema)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        # only where the text changed: a given count is otherwise left alone
        old = F.col(f"row.c{docs.columns.index('text')}")
        changed["n_chars"] = F.when(F.col("text").eqNullSafe(old), F.col(f"row.c{docs.columns.index('n_chars')}")).otherwise(F.length("text"))
    return unpacked(out, docs, **changed)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))

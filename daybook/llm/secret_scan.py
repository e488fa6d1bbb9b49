"""Secrets in message texts: fixed rules plus a character convolutional network."""

from __future__ import annotations

import hashlib
import re
import string
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.texts import text_columns
from daybook.session import durable

# --- fixed values: the base rules ----------------------------------------------------------
KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32}")
WORDS_BEFORE = ("password", "passwd", "secret", "token", "api_key", "apikey")
# --- end of fixed values --------------------------------------------------------------------

#: What may be a secret: a run of key characters.  A word of one case, or capitalised, is none if it
#: is short enough for a word: nothing in its characters could tell it from one.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
PLAIN_WORD = re.compile(r"[A-Z]?[a-z]{0,19}|[A-Z]{1,19}")
#: Labelled findings that one training group holds, pairs of findings made by rule that all groups
#: have together at least, and groups whose weights are averaged at a time.
GROUP_FINDINGS = 5_000
MADE = 2_000
AVERAGED = 32
BEFORE, INSIDE, AFTER = 24, 48, 8
LENGTH = BEFORE + INSIDE + AFTER
_FOUND = "rowid long, start int, end int, secret int, window string"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules' matches, by start and then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS_BEFORE):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
                if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)
                if m.end() - m.start() >= 16]
    if LONG_HEX.search(text):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)
                if m.end() - m.start() >= 32]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that the network looks at."""
    return [m.span() for m in CANDIDATE.finditer(text) if not PLAIN_WORD.fullmatch(m.group())]


def windows(text: str, start: int, end: int) -> list[str]:
    """The candidate with its surroundings; a long one as several overlapping windows."""
    pad = " "
    before = text[max(0, start - BEFORE):start].rjust(BEFORE, pad)
    after = text[end:end + AFTER].ljust(AFTER, pad)
    body = text[start:end]
    cuts = range(0, max(1, len(body) - INSIDE // 2), INSIDE // 2)
    return [before + body[c:c + INSIDE].ljust(INSIDE, pad) + after for c in cuts]


def shapes(rows: list[str]) -> np.ndarray:
    """The shape of each window's candidate: digits alone 0, letters alone 1, anything else 2."""
    bodies = [r[BEFORE:BEFORE + INSIDE].rstrip() for r in rows]
    return np.array([0 if b.isdigit() else 1 if b.isalpha() else 2 for b in bodies], dtype=np.int64)


_ALPHABET = string.ascii_letters + string.digits + string.punctuation + " \n"
_CODE = np.full(256, len(_ALPHABET), dtype=np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
_SYMBOLS = len(_ALPHABET) + 1


def encode(rows: list[str]) -> np.ndarray:
    """Windows as symbol numbers; characters outside the alphabet share one."""
    flat = np.frombuffer("".join(rows).encode("latin-1", "replace"), dtype=np.uint8)
    return _CODE[flat].reshape(len(rows), LENGTH)


#: Stretches of a window whose maxima are kept apart, so that lengths and sides can be told.
STRETCHES = 4


@dataclass(frozen=True)
class Network:
    """Embedding, one convolution with ReLU and a maximum a stretch, a linear output, calibration."""

    embed: np.ndarray        # symbols x depth
    kernel: np.ndarray       # width * depth x filters
    bias: np.ndarray
    out: np.ndarray          # stretches * filters
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, ...] = (0.5, 0.5, 0.5)     # by shape
    width: int = 5
    precision: float = 1.0   # share of secrets among the held-back findings over the threshold

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stacked inputs of the convolution, its maxima by stretch and filter, their places)."""
        e = self.embed[x]
        n = x.shape[1] - self.width + 1
        cols = np.concatenate([e[:, k:k + n] for k in range(self.width)], axis=2)
        z = (cols @ self.kernel + self.bias).reshape(len(x), STRETCHES, n // STRETCHES, -1)
        at = z.argmax(axis=2)
        top = np.take_along_axis(z, at[:, :, None, :], axis=2)[:, :, 0]
        at += (np.arange(STRETCHES) * (n // STRETCHES))[:, None]
        return cols, top.reshape(len(x), -1), at.reshape(len(x), -1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return np.concatenate([np.maximum(self.hidden(x[a:a + 512])[1], 0) @ self.out
                               + self.out_bias for a in range(0, len(x), 512)])

    def probability(self, rows: list[str]) -> np.ndarray:
        z = self.scale * self.logits(encode(rows)) + self.shift if rows else np.zeros(0)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))

    def accepts(self, rows: list[str]) -> np.ndarray:
        """Which windows reach the threshold of their shape."""
        return self.probability(rows) >= np.array(self.thresholds)[shapes(rows)]


def made_values(n: int, seed: int = 11) -> tuple[list[str], list[str]]:
    """As many secrets as plain values, made by rule in six shapes each."""
    rng = np.random.default_rng(seed)
    pick = lambda pool, k: "".join(rng.choice(list(pool), k))
    words = ["report", "meeting", "order", "draft", "photo", "room", "flight", "page", "gate"]
    parts = ["ver", "keit", "tion", "ment", "ous", "er", "lich", "ing", "ance", "re", "ab", "schaft"]
    secrets, plain = [], []
    for i in range(n):
        k = int(rng.integers(16, 44))
        secrets.append([
            pick("0123456789abcdef", k), pick(string.ascii_letters + string.digits, k),
            pick(string.ascii_letters + string.digits + "+/", k) + "=",
            "sk_" + pick(string.ascii_lowercase + string.digits, k),
            pick(string.ascii_letters, k), pick(string.digits, k + 6)][i % 6])
        plain.append([
            "-".join([*rng.choice(words, 3), str(rng.integers(1, 3000))]),
            "_".join([*rng.choice(words, 2), "v" + str(rng.integers(1, 99)), "final"]),
            f"{rng.integers(1990, 2030)}-{rng.integers(1, 13)}-{rng.integers(1, 29)}T"
            f"{rng.integers(0, 24)}h", "/".join([*rng.choice(words, 3), "p2"]),
            "".join(rng.choice(parts, int(rng.integers(5, 9)))) + rng.choice(["", "-X", "SS"]),
            pick(string.digits, int(rng.integers(8, 18)))][i % 6])
    return secrets, plain


def made_findings(n: int, seed: int = 11) -> tuple[list[str], np.ndarray]:
    """Labelled findings made by rule, so that there is something to learn from in any corpus."""
    rng = np.random.default_rng(seed + 1)
    lead = ["key ", "Bearer ", "pwd: ", "use ", "auth=", "credential ", "", "is ", "send "]
    rows = []
    for pair in zip(*made_values(n, seed), strict=True):
        for body in pair:
            text = str(rng.choice(lead)) + body + " then"
            start = text.index(body)
            rows.append(windows(text, start, start + len(body))[0])
    return rows, np.tile([1.0, 0.0], n)


def planted(rows: list[str], seed: int = 12) -> list[str]:
    """Secrets made by rule, each in the surroundings of one of the windows ``rows``."""
    values, _ = made_values(len(rows), seed)
    return [r[:BEFORE] + v[:INSIDE].ljust(INSIDE) + r[BEFORE + INSIDE:]
            for r, v in zip(rows, values, strict=True)]


def _first_weights(rng: np.random.Generator, filters: int = 24, depth: int = 8,
                   ) -> list[np.ndarray]:
    return [rng.normal(0, 0.3, (_SYMBOLS, depth)), rng.normal(0, 0.2, (5 * depth, filters)),
            np.zeros(filters), rng.normal(0, 0.2, STRETCHES * filters), np.zeros(1)]


def _draws(grp: int) -> np.random.Generator:
    """The random numbers of a training group: what is held back, then what each epoch draws."""
    return np.random.default_rng(3 + grp)


def _network(params: list[np.ndarray], **more) -> Network:
    return Network(*params[:4], float(params[4][0]), **more)


def _epoch(params: list[np.ndarray], m1: list[np.ndarray], m2: list[np.ndarray], step: int,
           x: np.ndarray, label: np.ndarray, rng: np.random.Generator, rate: float = 0.01) -> int:
    """One pass of Adam over the encoded findings, in place; returns the steps taken so far.

    In most of the rows the surroundings are blanked, so that the value alone also counts.
    """
    blank = _CODE[ord(" ")]
    for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
        xb, yb = x[batch].copy(), label[batch]
        hide = rng.random(len(batch)) < 0.85
        xb[hide, :BEFORE] = blank
        xb[hide, BEFORE + INSIDE:] = blank
        net = _network(params)
        cols, top, at = net.hidden(xb)
        act = np.maximum(top, 0)
        p = 1.0 / (1.0 + np.exp(-np.clip(act @ net.out + net.out_bias, -35, 35)))
        d = (p - yb) / len(batch)
        back = np.outer(d, net.out) * (top > 0)
        picked = np.take_along_axis(cols, at[:, :, None], axis=1)
        by_place = back.reshape(len(batch), STRETCHES, -1)
        g_kernel = np.einsum("bsfc,bsf->cf", picked.reshape(*by_place.shape, -1), by_place)
        g_cols = by_place[:, :, :, None] * net.kernel.T
        g_embed = np.zeros_like(net.embed)
        depth = net.embed.shape[1]
        for k in range(net.width):
            symbol = np.take_along_axis(xb, at + k, axis=1).reshape(by_place.shape)
            np.add.at(g_embed, symbol, g_cols[..., k * depth:(k + 1) * depth])
        step += 1
        for q, g, a, b in zip(params, (g_embed, g_kernel, by_place.sum((0, 1)), act.T @ d,
                                       np.array([d.sum()])), m1, m2, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            q -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return step


def _probability(z: np.ndarray, scale: float, shift: float) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(scale * z + shift, -35, 35)))


def _calibration(z: np.ndarray, truth: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit to ``n`` findings of logit ``z`` each."""
    scale, shift = 1.0, 0.0
    for _ in range(200):
        off = (_probability(z, scale, shift) - truth) * n
        scale -= 0.05 * (off * z).sum() / n.sum()
        shift -= 0.05 * off.sum() / n.sum()
    return float(scale), float(shift)


def fit_network(rows: list[str], label: np.ndarray, recall: float = 0.99, epochs: int = 8,
                filters: int = 24, depth: int = 8, rate: float = 0.01, seed: int = 3) -> Network:
    """Train with Adam on four fifths of a list of findings; calibrate on the rest.

    The output is scaled to probabilities by a logistic fit, and the threshold of each
    shape of candidate is the highest that still finds ``recall`` of its held-back secrets (of all
    of them, if the shape has none); ``precision`` is what the thresholds give.
    """
    rng = np.random.default_rng(seed)
    x = encode(rows)
    held = rng.random(len(x)) < 0.2
    params = _first_weights(rng, filters, depth)
    m1 = [np.zeros_like(p) for p in params]
    m2 = [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        step = _epoch(params, m1, m2, step, x[~held], label[~held], rng, rate)
    net = _network(params)
    check = held if 0 < label[held].sum() < held.sum() else np.ones(len(x), dtype=bool)
    z, truth = net.logits(x[check]), label[check]
    scale, shift = _calibration(z, truth, np.ones(len(z)))
    p = _probability(z, scale, shift)
    shape = shapes([r for r, c in zip(rows, check, strict=True) if c])

    def reached(secrets: np.ndarray) -> float:
        found = np.sort(p[secrets])
        return float(found[int((1 - recall) * len(found))]) if len(found) else 0.5

    own = [(truth == 1) & (shape == k) for k in range(3)]
    thresholds = tuple(reached(o if o.any() else truth == 1) for o in own)
    taken = truth[p >= np.array(thresholds)[shape]]
    return _network(params, scale=scale, shift=shift, thresholds=thresholds,
                    precision=float(taken.mean()) if len(taken) else 1.0)


def _overlaps(span: tuple[int, int], spans: list[tuple[int, int, str]]) -> bool:
    return any(a < span[1] and span[0] < b for a, b, _ in spans)


def _inside(span: tuple[int, int], spans: list[tuple[int, int, str]]) -> bool:
    return any(a <= span[0] and span[1] <= b for a, b, _ in spans)


def found_spans(texts: list[str], net: Network) -> list[list[tuple[int, int, str]]]:
    """Base and learned spans of each text; a learned one is never part of a base one."""
    base = [base_spans(t) for t in texts]
    spans, rows, owner = [], [], []
    for i, text in enumerate(texts):
        for a, b in candidates(text):
            if not _inside((a, b), base[i]):
                w = windows(text, a, b)
                rows += w
                owner += [len(spans)] * len(w)
                spans.append((i, a, b))
    taken = np.zeros(len(spans), dtype=bool)
    if rows:
        np.logical_or.at(taken, owner, net.accepts(rows))
    for i, a, b in (s for s, t in zip(spans, taken, strict=True) if t):
        base[i].append((a, b, "learned"))
    return [sorted(s, key=lambda x: (x[0], KINDS.index(x[2]))) for s in base]


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def reads_plainly(value: str) -> bool:
    """True for a value of few changes between letters of a case, digits and marks.

    Digits alone are plain up to the length of an account number.
    """
    if value.isdigit():
        return len(value) < 20
    kind = [c.islower() + 2 * c.isupper() + 4 * c.isdigit() for c in value]
    return sum(a != b for a, b in zip(kind, kind[1:])) <= len(value) // 4


def labelled_findings(messages: DataFrame) -> DataFrame:
    """Findings of ``messages(rowid, text)``: candidates inside base matches are secrets, those
    clear of them that read plainly are not, and any others are left without a label.

    ``rowid, start, end, secret, window``; of a long candidate the first window.  NULL and empty
    bodies have none, repeated rows have theirs each, an empty table gives an empty one.
    """
    def find(batches):
        for batch in batches:
            rows = []
            for rowid, text in zip(batch["rowid"], batch["text"], strict=True):
                text = text or ""
                base = base_spans(text)
                inside = [(a, b, int(_inside((a, b), base))) for a, b in candidates(text)]
                rows += [(rowid, a, b, s, windows(text, a, b)[0]) for a, b, s in inside if s or (
                    reads_plainly(text[a:b]) and not _overlaps((a, b), base))]
            yield pd.DataFrame(rows, columns=["rowid", "start", "end", "secret", "window"])
    return messages.select(F.col("rowid").cast("long"), "text").mapInPandas(find, _FOUND)


def training_rows(findings: DataFrame, most: int = GROUP_FINDINGS) -> tuple[DataFrame, int]:
    """What the network learns from, as ``grp, no, window, secret, held``, and the number of groups.

    Every finding with a window is in exactly one group, by the hash of its row, place and window,
    so groups do not depend on the layout; about ``most`` are in one.  Every plain finding
    also lends its surroundings to a secret made by rule, so that the surroundings alone decide
    nothing, and each group adds findings made whole, without which a corpus with one class could
    teach nothing.  A fifth of a group is held back from training.
    """
    placed = durable(findings.filter("window IS NOT NULL").select(
        "rowid", "start", "secret", "window",
        F.xxhash64("rowid", "start", "window").alias("place")))
    groups = max(1, -(-placed.count() // most))
    dealt = placed.withColumn("grp", F.pmod("place", F.lit(groups)))
    made = max(-(-MADE // groups), min(most, GROUP_FINDINGS) // 10)

    def deal(key: tuple, _: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        grp = int(key[0])
        own = own.sort_values(["place", "rowid", "start", "window"])
        plain = own["window"][own["secret"] == 0].tolist()
        secret = own["window"][own["secret"] == 1].tolist()
        rows, label = made_findings(made, seed=11 + 1000 * grp)
        more = planted(plain, seed=12 + 1000 * grp)
        label = np.r_[label, np.zeros(len(plain)), np.ones(len(more) + len(secret))]
        return pd.DataFrame({
            "grp": grp, "no": np.arange(len(label)), "window": rows + plain + more + secret,
            "secret": label.astype(np.int32), "held": _draws(grp).random(len(label)) < 0.2})

    rows = (findings.sparkSession.range(groups).withColumnRenamed("id", "grp").groupBy("grp")
            .cogroup(dealt.groupBy("grp"))
            .applyInPandas(deal, "grp long, no int, window string, secret int, held boolean"))
    return durable(rows), groups


def _averaged(parts: DataFrame, groups: int) -> np.ndarray:
    """The mean of the groups' weights by their numbers of rows, always added in one order."""
    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("grp")
        n = rows["n"].to_numpy()
        w = np.stack([np.frombuffer(b) for b in rows["weights"]])
        return pd.DataFrame({"grp": [int(rows["grp"].iloc[0]) // AVERAGED], "n": [int(n.sum())],
                             "weights": [((n[:, None] * w).sum(axis=0) / max(n.sum(), 1))
                                         .tobytes()]})

    while True:
        parts = parts.groupBy(F.floor(F.col("grp") / AVERAGED)).applyInPandas(
            mean, "grp long, n long, weights binary")
        groups = -(-groups // AVERAGED)
        if groups == 1:
            return np.frombuffer(parts.first()["weights"])


def fit_secret_network(findings: DataFrame, most: int = GROUP_FINDINGS, recall: float = 0.99,
                       epochs: int = 8) -> Network:
    """Learn from all ``findings(rowid, start, secret, window)``, 1 for a secret.

    The findings are read once and dealt to groups (``training_rows``).  Each epoch, every group
    makes one pass of Adam from the common weights, and the weights and moments are averaged; what
    reaches the driver is one set of them an epoch.  The output is scaled to probabilities on all
    held-back findings, counted by logit; the threshold of each shape of candidate is the highest
    that still finds ``recall`` of its held-back secrets (of all of them, if the shape has none),
    taken from the lowest logits themselves; ``precision`` is what the thresholds give.  Findings
    without a window are left out; of an empty table only the made findings are learned from.
    """
    rows, groups = training_rows(findings, most)
    rng = _draws(0)
    rng.random(rows.filter("grp = 0").count())
    first = _first_weights(rng)
    cuts = np.cumsum([p.size for p in first])
    size = int(cuts[-1])

    def unpacked(flat: np.ndarray) -> list[np.ndarray]:
        return [f.reshape(p.shape).copy() for f, p in zip(np.split(flat, cuts[:-1]), first,
                                                          strict=True)]

    state, step = np.r_[np.concatenate([p.ravel() for p in first]), np.zeros(2 * size)], 0.0

    def learner(flat: np.ndarray, step: int, epoch: int):
        def learn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            rng = _draws(int(key[0]))
            rng.random(len(group))
            _first_weights(rng)
            group = group[~group["held"]].sort_values("no")
            for _ in range(epoch):                      # go on where the last epoch stopped
                rng.permutation(len(group))
                rng.random(len(group))
            sets = [unpacked(part) for part in np.split(flat, 3)]
            done = _epoch(*sets, step, encode(group["window"].tolist()),
                          group["secret"].to_numpy(dtype=np.float64), rng)
            out = np.concatenate([q.ravel() for s in sets for q in s] + [[float(done)]])
            return pd.DataFrame({"grp": [key[0]], "n": [len(group)], "weights": [out.tobytes()]})
        return learn

    train = rows.groupBy("grp")
    for epoch in range(epochs):
        mean = _averaged(train.applyInPandas(learner(state, int(step), epoch),
                                             "grp long, n long, weights binary"), groups)
        state, step = mean[:-1], mean[-1]
    net = _network(unpacked(state[:size]))

    def judge(batches):
        for batch in batches:
            yield pd.DataFrame({"held": batch["held"], "truth": batch["secret"],
                                "shape": shapes(batch["window"].tolist()),
                                "z": net.logits(encode(batch["window"].tolist()))})

    told = durable(rows.mapInPandas(judge, "held boolean, truth int, shape int, z double"))
    n, secrets = told.filter("held").agg(F.count("*"), F.sum("truth")).first()
    told = told.filter("held") if 0 < (secrets or 0) < n else told
    bins = told.groupBy(F.round(F.greatest(F.least("z", F.lit(99.0)), F.lit(-99.0)), 2).alias("b"),
                        "truth").agg(F.count("*").alias("n"), F.avg("z").alias("z")).toPandas()
    scale, shift = _calibration(*(bins[c].to_numpy(dtype=np.float64) for c in ("z", "truth", "n")))

    true = told.filter("truth = 1")
    count = {r["shape"]: r["count"] for r in true.groupBy("shape").count().collect()}

    def reached(secrets: DataFrame, n: int) -> float:
        """The lowest logit taken: of ``n`` secrets all but the least (1 - recall) * n."""
        return secrets.orderBy("z").limit(int((1 - recall) * n) + 1).agg(F.max("z")).first()[0]

    least = [reached(true.filter(F.col("shape") == k), count[k]) if k in count
             else reached(true, sum(count.values())) for k in range(3)]
    taken = told.filter(F.col("z") >= F.array(*map(F.lit, least))[F.col("shape")]).agg(
        F.avg("truth")).first()[0]
    return _network(unpacked(state[:size]), scale=scale, shift=shift,
                    thresholds=tuple(float(_probability(z, scale, shift)) for z in least),
                    precision=1.0 if taken is None else float(taken))


def secret_columns(net: Network):
    """text -> struct(n_assign, n_access, n_hex, base_sha256, spans)."""
    def work(texts: list[str]) -> dict:
        found = found_spans(texts, net)
        base = [[s for s in f if s[2] != "learned"] for f in found]
        return {f"n_{kind}": [sum(s[2] == kind for s in f) for f in base]
                for kind in KINDS[:3]} | {
            "base_sha256": [hashlib.sha256(_written(f).encode()).hexdigest() for f in base],
            "spans": [_written(f) for f in found]}
    return text_columns("n_assign long, n_access long, n_hex long, base_sha256 string, "
                        "spans string", work)


def redacted_column(net: Network, mark: str):
    """text -> struct(text, changed): every found span, overlaps united, replaced by ``mark``."""
    def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
        parts, at = [], 0
        for a, b, _ in spans:
            if a >= at:
                parts += [text[at:a], mark]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    def work(texts: list[str | None]) -> dict:
        found = found_spans([t or "" for t in texts], net)
        done = [t if t is None else redact(t, s) for t, s in zip(texts, found, strict=True)]
        return {"text": done, "changed": [bool(s) for s in found]}
    return text_columns("text string, changed boolean", work, keep_null=True)


def scan_secrets(messages: DataFrame, net: Network, text: str | Column = "text") -> DataFrame:
    """Secrets of every message body: counts, digest of the base spans, and all spans.

    ``messages``: ``rowid, text`` (other columns are ignored).  ``spans`` lists
    ``kind:start:end`` in code points by start, then kind; the network adds ``learned`` spans
    beside the rules' and takes none away; one may reach over a rule's, none lies inside it.  Map-only: every candidate with its surroundings is
    judged where it stands.  NULL and empty bodies have none; repeated rows and rows without an id
    are scanned each; long bodies and long candidates are read whole; spans that begin together are
    ordered by kind; an empty table gives an empty table.
    """
    found = messages.select("rowid", secret_columns(net)(text).alias("s"))
    return found.select("rowid", "s.*")

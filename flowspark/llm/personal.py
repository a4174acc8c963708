r"""Personal data in text: fixed rules, and a character-level bidirectional LSTM with CRF transitions.

The rules find e-mail addresses, IP addresses, payment cards and phone numbers in whole texts.
Their matches label windows of text for training, together with rewritten forms of the same
matches (addresses with the signs spelt out, numbers with other separators) that the rules do
not know. The network, trained in numpy in one task on a bounded sample, then looks at all
windows that hold a digit, an at sign or a spelt-out sign; no span is possible without one.

Windows overlap by half. Each is decoded by Viterbi. What the windows of a text say is
reconciled over the whole text: stretches of one kind that overlap become one, and of all
stretches, the rules' own ones fixed, the set without overlaps that has the largest sum of
probabilities is kept.
"""

from __future__ import annotations

import heapq
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: A window and the step between windows, in characters.
WIDTH, STEP = 96, 48
#: Bound of the training sample: windows of each kind, and of windows without any span.
PER_KIND, WITHOUT = 400, 2000
#: Shares of the drawn windows that are cut to the bound by themselves first.
SHARES = 64
HIDDEN, EPOCHS, BATCH, RATE = 24, 8, 64, 0.02
#: A stretch is added when its mean probability is at least this.
ACCEPT, SHORTEST = 0.9, 6

Span = tuple[int, int, int]

# --- the rules ---------------------------------------------------------------------

# Greedy parts are possessive and numbers start where no digit stands before, which changes
# no match but keeps long runs of digits linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: from each at sign back over its local part, forward over its domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield EMAIL, start, done
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    twice = [d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2])]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Matches of the rules as (kind, start, end), and those that failed a rule's check."""
    found, failed = list(_emails(text)), []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            ok = all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.group().split("."))
            (found if ok else failed).append((IP, *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() <= 38 else ""
            (found if 16 <= len(digits) <= 19 and luhn(digits) else failed).append((CARD, *m.span()))
        for m in _PHONE.finditer(text):
            n = sum(c.isdigit() for c in m.group()) if m.end() - m.start() <= 4096 else sum(1 for _ in _DIGIT.finditer(text, *m.span()))
            (found if 8 <= n <= 15 else failed).append((PHONE, *m.span()))
    return found, failed


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for k, start, end in sorted(spans))


# --- windows -----------------------------------------------------------------------

_CUE = re.compile(r"[0-9@]|[(\[](?:at|dot)[)\]]| dot ")


def windows(text: str) -> list[int]:
    """Starts of the windows that hold a cue, in order."""
    starts, upto = [], 0
    for m in _CUE.finditer(text):
        block = m.start() // STEP
        if block >= upto:
            starts += [b * STEP for b in range(max(block - 1, upto - 1, 0), block + 1) if not starts or b * STEP > starts[-1]]
            upto = block + 1
    return starts


_CODES = np.full(256, 0, np.int64)
_CODES[:128] = np.arange(128)
_CODES[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CODES[ord("0") : ord("9") + 1] = ord("0")
LETTER, OTHER, PAD, SIZE = 128, 129, 130, 131


def codes(window: str) -> np.ndarray:
    """Characters as small numbers: ASCII without case, all digits alike, other letters alike; padded."""
    points = np.fromiter(map(ord, window), np.int64, len(window))
    out = np.full(WIDTH, PAD, np.int64)
    out[: len(points)] = np.where(points < 128, _CODES[np.minimum(points, 255)], OTHER)
    for i in np.flatnonzero(points >= 128):
        out[i] = LETTER if window[i].isalpha() else OTHER
    return out


def tags(spans: list[Span], start: int) -> np.ndarray:
    """Tag of each character of a window: 0, or 1 + kind; where spans overlap, the earlier kind."""
    out = np.zeros(WIDTH, np.int8)
    for k, a, b in sorted(spans, reverse=True):
        out[max(0, a - start) : max(0, min(WIDTH, b - start))] = k + 1
    return out


# --- the network -------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Characters to tag scores by an LSTM each way, and to tags by a linear-chain CRF.

    weights: input (2, SIZE, 4H), state (2, H, 4H), out (2H, K), bias (K), move (K, K),
    first (K), last (K). Direction 1 reads windows backwards.
    """

    K = 1 + len(KINDS)

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng, h = np.random.default_rng(seed), HIDDEN
        w = {
            "input": rng.normal(0, 0.1, (2, SIZE, 4 * h)), "state": rng.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)),
            "out": rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, cls.K)), "bias": np.zeros(cls.K),
            "move": np.eye(cls.K), "first": np.zeros(cls.K), "last": np.zeros(cls.K),
        }
        w["input"][:, :, h : 2 * h] += 1.0  # gates that forget start open
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def to_bytes(self) -> bytes:
        return b"".join(self.w[k].tobytes() for k in sorted(self.w))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Network:
        w, at = cls.fresh(0).w, 0
        for k in sorted(w):
            n = w[k].size
            w[k] = np.frombuffer(raw, np.float32, n, at).reshape(w[k].shape).copy()
            at += 4 * n
        return cls(w)

    def scores(self, ids: np.ndarray) -> tuple[np.ndarray, dict]:
        """ids (B, T) to tag scores (T, B, K), and what the way back needs."""
        b, t = ids.shape
        both = np.stack([ids.T, ids.T[::-1]])  # direction, time, row
        h = HIDDEN
        gates = np.empty((t, 2, b, 4 * h), np.float32)
        cell, state, tcell = (np.zeros((t + 1, 2, b, h), np.float32) for _ in range(3))
        for i in range(t):
            z = np.matmul(state[i], self.w["state"])
            z[0] += self.w["input"][0, both[0, i]]
            z[1] += self.w["input"][1, both[1, i]]
            z[..., : 3 * h] = _sigmoid(z[..., : 3 * h])
            z[..., 3 * h :] = np.tanh(z[..., 3 * h :])
            gates[i] = z
            cell[i + 1] = z[..., h : 2 * h] * cell[i] + z[..., :h] * z[..., 3 * h :]
            tcell[i + 1] = np.tanh(cell[i + 1])
            state[i + 1] = z[..., 2 * h : 3 * h] * tcell[i + 1]
        seen = np.concatenate([state[1:, 0], state[:0:-1, 1]], axis=-1)
        return seen @ self.w["out"] + self.w["bias"], {"both": both, "gates": gates, "cell": cell, "state": state, "tcell": tcell, "seen": seen}

    def _back(self, kept: dict, d_scores: np.ndarray) -> dict[str, np.ndarray]:
        t, b, _ = d_scores.shape
        h, gates, cell, state, tcell = HIDDEN, kept["gates"], kept["cell"], kept["state"], kept["tcell"]
        flat = d_scores.reshape(t * b, -1)
        grad = {"out": kept["seen"].reshape(t * b, -1).T @ flat, "bias": flat.sum(axis=0)}
        d_seen = d_scores @ self.w["out"].T
        d_state = np.stack([d_seen[..., :h], d_seen[::-1, :, h:]], axis=1)
        dz = np.empty_like(gates)
        later_state, later_cell = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
        turned = self.w["state"].transpose(0, 2, 1)
        for i in range(t - 1, -1, -1):
            g_in, g_keep, g_out, g_new = (gates[i][..., j * h : (j + 1) * h] for j in range(4))
            dh = d_state[i] + later_state
            dc = later_cell + dh * g_out * (1 - tcell[i + 1] ** 2)
            dz[i, ..., :h] = dc * g_new * g_in * (1 - g_in)
            dz[i, ..., h : 2 * h] = dc * cell[i] * g_keep * (1 - g_keep)
            dz[i, ..., 2 * h : 3 * h] = dh * tcell[i + 1] * g_out * (1 - g_out)
            dz[i, ..., 3 * h :] = dc * g_in * (1 - g_new**2)
            later_cell, later_state = dc * g_keep, np.matmul(dz[i], turned)
        grad["state"], grad["input"] = np.empty_like(self.w["state"]), np.empty_like(self.w["input"])
        for d in range(2):
            each = dz[:, d].reshape(t * b, 4 * h)
            grad["state"][d] = state[:-1, d].reshape(t * b, h).T @ each
            one = np.zeros((t * b, SIZE), np.float32)
            one[np.arange(t * b), kept["both"][d].reshape(-1)] = 1
            grad["input"][d] = one.T @ each
        return grad

    def _forward_backward(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward and backward values, the scaled emissions and the log of the sum over all paths."""
        t, b, _ = scores.shape
        top = scores.max(axis=-1, keepdims=True)
        emit, move = np.exp(scores - top), np.exp(self.w["move"])
        ahead, behind = np.empty_like(emit), np.empty_like(emit)
        total = top[..., 0].sum(axis=0)
        now = np.exp(self.w["first"]) * emit[0]
        for i in range(t):
            now = now if i == 0 else (now @ move) * emit[i]
            scale = now.sum(axis=-1, keepdims=True)
            now = now / scale
            total = total + np.log(scale[:, 0])
            ahead[i] = now
        total = total + np.log(now @ np.exp(self.w["last"]))
        now = np.broadcast_to(np.exp(self.w["last"]), (b, self.K))
        for i in range(t - 1, -1, -1):
            behind[i] = now = now / now.sum(axis=-1, keepdims=True)
            now = (now * emit[i]) @ move.T
        return ahead, behind, emit, total

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        ahead, behind, _, _ = self._forward_backward(scores)
        both = ahead * behind
        return both / both.sum(axis=-1, keepdims=True)

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """The best tags (T, B)."""
        t, b, _ = scores.shape
        best, back = self.w["first"] + scores[0], np.empty(scores.shape, np.int8)
        for i in range(1, t):
            ways = best[:, :, None] + self.w["move"]
            back[i] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[i]
        path = np.empty((t, b), np.int8)
        path[-1] = (best + self.w["last"]).argmax(axis=-1)
        for i in range(t - 1, 0, -1):
            path[i - 1] = back[i][np.arange(b), path[i]]
        return path

    def loss(self, ids: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags (B, T), and its gradients."""
        scores, kept = self.scores(ids)
        y, (t, b, k) = truth.T.astype(np.int64), scores.shape
        ahead, behind, emit, total = self._forward_backward(scores)
        one = np.eye(k, dtype=np.float32)[y]
        near = ahead * behind
        near /= near.sum(axis=-1, keepdims=True)
        move = np.exp(self.w["move"])
        pairs = ahead[:-1, :, :, None] * move * (behind[1:] * emit[1:])[:, :, None, :]
        pairs /= pairs.sum(axis=(-1, -2), keepdims=True)
        grad = self._back(kept, ((near - one) / b).astype(np.float32))
        counts = np.zeros((k, k), np.float32)
        np.add.at(counts, (y[:-1].reshape(-1), y[1:].reshape(-1)), 1)
        grad["move"] = (pairs.sum(axis=(0, 1)) - counts) / b
        grad["first"], grad["last"] = (near[0] - one[0]).mean(axis=0), (near[-1] - one[-1]).mean(axis=0)
        path = np.take_along_axis(scores, y[..., None], -1)[..., 0].sum(axis=0)
        path = path + self.w["move"][y[:-1], y[1:]].sum(axis=0) + self.w["first"][y[0]] + self.w["last"][y[-1]]
        return float((total - path).mean()), grad


def train(texts: list[str], labels: list[bytes], seed: int = 11, epochs: int = EPOCHS) -> Network:
    """A network from windows and their tags, by Adam steps in shuffled batches."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    ids = np.stack([codes(t) for t in texts])
    truth = np.stack([np.frombuffer(x, np.int8) for x in labels])
    mean, square = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    steps, n = epochs * -(-len(texts) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            n += 1
            _, grad = net.loss(ids[order[at : at + BATCH]], truth[order[at : at + BATCH]])
            size = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            rate = RATE * (1 - 0.95 * n / steps) * np.sqrt(1 - 0.999**n) / (1 - 0.9**n)
            for k, g in grad.items():
                g = g * min(1.0, 5 / max(size, 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                net.w[k] = (net.w[k] - rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return net


# --- labelled windows --------------------------------------------------------------


def rewritten(kind: int, match: str, rng: random.Random) -> str:
    """A match in a form that its rule does not know."""
    if kind == EMAIL:
        at, dot = rng.choice([("(at)", "."), ("[at]", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", "."), ("(at)", "(dot)")])
        local, _, domain = match.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == PHONE:
        bare = re.sub(r"^\+[0-9]{1,2}[\x20.-]?", "", match)
        return rng.choice([bare, re.sub(r"[^0-9]+", ".", bare).strip("."), re.sub(r"[^0-9]+", "-", bare).strip("-"), re.sub(r"[^0-9]+", " ", bare).strip()])
    digits = re.sub(r"[^0-9]", "", match)
    if kind == CARD:
        return rng.choice([".", "/", "  ", "_"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return match.replace(".", rng.choice(["[.]", "(.)", " . "]))


def harmless(rng: random.Random) -> str:
    """A number that is no personal data: a date, a time, a version, an amount, a range."""
    a, b, c = rng.randint(1, 28), rng.randint(1, 12), rng.randint(1900, 2099)
    return rng.choice([
        f"{c}-{b:02}-{a:02}", f"{a:02}/{b:02}/{c}", f"{a}.{b}.{c}", f"{b:02}:{a:02}", f"{b:02}:{a:02}:{a + 20}", f"{c}", f"{c}-{c + a}",
        f"v{b}.{a}", f"{b}.{a}.{rng.randint(0, 40)}", f"{a},{rng.randint(100, 999)}.{b:02}", f"{rng.randint(0, 10 ** rng.randint(1, 9))}",
        f"{a} {rng.randint(100, 999)} {rng.randint(100, 999)}", f"{a}%", f"${rng.randint(1, 10**6)}.{a:02}", f"#{rng.randint(1, 10**6)}", f"{a}-{a + b}",
    ])


def _replaced(text: str, start: int, span: Span, other: str, tag: int, rng: random.Random) -> tuple[str, bytes]:
    """The window at start, moved a little, with the match replaced, and its tags."""
    _, a, b = span
    shift = min(start, rng.randint(0, max(0, WIDTH - len(other) - (a - start)) // 2))
    piece = (text[start - shift : a] + other + text[b : b + WIDTH])[:WIDTH]
    at = a - start + shift
    return piece, tags([(tag, at, at + len(other))] if tag >= 0 else [], 0).tobytes()


def labelled_windows(text: str) -> Iterator[tuple[int, str, bytes]]:
    """(kind, window, tags) of a text's windows that hold a span or none (kind -1).

    Where a window holds one match only, it is also given with the match rewritten, and with a
    harmless number in its place.
    """
    found, failed = base_spans(text)
    for start in windows(text):
        piece = text[start : start + WIDTH]
        inside = [s for s in found if s[1] < start + WIDTH and s[2] > start]
        if not inside:
            yield -1, piece, tags([], start).tobytes()
            continue
        yield inside[0][0], piece, tags(inside, start).tobytes()
        kind, a, b = inside[0]
        if len(inside) == 1 and start <= a and b <= start + WIDTH:
            rng = random.Random(xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass")))
            yield kind, *_replaced(text, start, inside[0], rewritten(kind, text[a:b], rng), kind, rng)
            yield -1, *_replaced(text, start, inside[0], harmless(rng), -1, rng)


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The windows of a task with the smallest hashes, so many of each kind; equal windows count once."""
    heaps: dict[int, list] = {}
    taken: dict[int, set] = {}
    for batch in batches:
        for text in batch["text"]:
            for kind, piece, label in labelled_windows(text if isinstance(text, str) else ""):
                heap, known = heaps.setdefault(kind, []), taken.setdefault(kind, set())
                entry = (-(xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass") + label) >> 1), piece, label)
                if entry[0] in known or (len(heap) == _limit(kind) and entry < heap[0]):
                    continue
                known.add(entry[0])
                if len(heap) < _limit(kind):
                    heapq.heappush(heap, entry)
                else:
                    known.discard(heapq.heappushpop(heap, entry)[0])
    rows = [(kind, -place, piece, label) for kind, heap in heaps.items() for place, piece, label in heap]
    if rows:
        yield pd.DataFrame(rows, columns=["kind", "place", "piece", "tags"])


def _limit(kind: int) -> int:
    return WITHOUT if kind < 0 else 2 * PER_KIND


def fit(docs: DataFrame) -> bytes | None:
    """The network as bytes, trained in one task on at most 4 x 2 x PER_KIND + WITHOUT windows of all texts.

    Which windows are taken depends on hashes of the windows alone. None where no text has a span.
    """
    drawn = docs.select("text").mapInPandas(_sampled, "kind int, place long, piece string, tags binary").dropDuplicates(["kind", "place"])
    # First among the windows of a share of the hashes, then among those that are left.
    limit, most = F.when(F.col("kind") < 0, WITHOUT).otherwise(2 * PER_KIND), max(WITHOUT, 2 * PER_KIND)
    for group in (["kind", F.pmod(F.col("place"), F.lit(SHARES))], ["kind"]):
        order = Window.partitionBy(*group).orderBy("place")
        drawn = drawn.withColumn("_turn", F.row_number().over(order)).where(F.col("_turn") <= most)
        drawn = drawn.where(F.col("_turn") <= limit).drop("_turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches) or [pd.DataFrame({"kind": [], "place": [], "piece": [], "tags": []})], ignore_index=True)
        if (rows["kind"] >= 0).any():
            rows = rows.sort_values(["kind", "place"])
            yield pd.DataFrame({"model": [train(list(rows["piece"]), list(rows["tags"])).to_bytes()]})

    row = drawn.repartition(1).mapInPandas(run, "model binary").first()
    return bytes(row["model"]) if row else None


# --- finding -----------------------------------------------------------------------


@dataclass
class Tagger:
    """Added spans of texts, by the network."""

    net: Network
    batch: int = 256

    def stretches(self, pieces: list[str]) -> list[list[tuple[int, int, int, float]]]:
        """For each window its decoded (kind, start, end, sum of probabilities)."""
        out: list[list[tuple[int, int, int, float]]] = []
        for at in range(0, len(pieces), self.batch):
            part = pieces[at : at + self.batch]
            scores, _ = self.net.scores(np.stack([codes(p) for p in part]))
            near, path = self.net.marginals(scores), self.net.viterbi(scores)
            for i, piece in enumerate(part):
                tag = path[: len(piece), i]
                edge = np.flatnonzero(np.diff(tag, prepend=0, append=0))
                found = []
                for a, b in zip(edge, edge[1:]):
                    if tag[a]:
                        found.append((int(tag[a]) - 1, int(a), int(b), float(near[a:b, i, tag[a]].sum())))
                out.append(found)
        return out

    def added(self, texts: list[str], known: list[tuple[list[Span], list[Span]]]) -> list[list[Span]]:
        """Spans beside the known ones, for each text."""
        starts = [windows(t) for t in texts]
        told = iter(self.stretches([t[s : s + WIDTH] for t, at in zip(texts, starts, strict=True) for s in at]))
        out = []
        for text, at, (base, failed) in zip(texts, starts, known, strict=True):
            said = [(k, s + a, s + b, p) for s in at for k, a, b, p in next(told)]
            out.append(reconciled(text, said, base, failed))
        return out


def reconciled(text: str, said: list[tuple[int, int, int, float]], base: list[Span], failed: list[Span]) -> list[Span]:
    """What the windows of one text say, made one: overlapping stretches of a kind are united, then
    the set of stretches without overlap that has the largest sum of probabilities is taken.

    A stretch gives way to matches of the rules, and to those of its kind that a rule refused.
    """
    united: list[list] = []
    for k, a, b, p in sorted(said):
        last = united[-1] if united else None
        if last and last[0] == k and a < last[2]:
            share = max(last[3] / (last[2] - last[1]), p / (b - a))
            last[2] = max(last[2], b)
            last[3] = share * (last[2] - last[1])
        else:
            united.append([k, a, b, p])
    taken = _Cover([s[1:] for s in base])
    refused = [_Cover([s[1:] for s in failed if s[0] == k]) for k in range(len(KINDS))]
    ways = []
    for k, a, b, p in united:
        share, piece = p / (b - a), text[a:b]
        a, b = a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())
        if share >= ACCEPT and b - a >= SHORTEST and _CUE.search(text, a, b) and not taken.meets(a, b) and not refused[k].meets(a, b):
            ways.append((b, a, k, share * (b - a)))
    ways.sort()
    ends = [w[0] for w in ways]
    best = [(0.0, -1)]  # of the first n stretches: the sum, and the last one that is taken
    for n, (b, a, _, weight) in enumerate(ways):
        before = bisect_right(ends, a, 0, n)
        best.append(max(best[n], (best[before][0] + weight, n), key=lambda x: x[0]))
    kept, n = [], len(ways)
    while n and best[n][1] >= 0:
        b, a, k, _ = ways[best[n][1]]
        kept.append((k, a, b))
        n = bisect_right(ends, a, 0, best[n][1])
    return kept


class _Cover:
    """Whether a stretch meets any of some stretches."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.reach = [], []
        for a, b in sorted(spans):
            self.starts.append(a)
            self.reach.append(max(b, self.reach[-1]) if self.reach else b)

    def meets(self, a: int, b: int) -> bool:
        at = bisect_right(self.starts, b - 1)
        return at > 0 and self.reach[at - 1] > a


def find(docs: DataFrame, *, key: str = "doc_id", model: bytes | None = None) -> DataFrame:
    """docs (key, text) to (key, base, added): personal data of whole texts as arrays of (kind, start, end).

    base has the matches of the rules, added what the network finds beside them; places are
    code points. Without a model one is trained on the texts themselves. Null texts are empty
    and empty texts have no span; texts may be of any length, as work grows with the length and
    a task holds a few texts at a time. Rows that share a key, and equal rows, are rows each. Columns
    beyond key and text are not read. An empty table gives no row.
    """
    given = docs.sparkSession.sparkContext.broadcast(model if model is not None else fit(docs))
    kind = docs.schema[key].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Network.from_bytes(given.value)) if given.value else None
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = [t or "" for t in part.column("text").to_pylist()]
                known = [base_spans(t) for t in texts]
                more = tagger.added(texts, known) if tagger else [[]] * len(texts)
                columns = [[[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(s)] for s in each] for each in ([f for f, _ in known], more)]
                yield pa.RecordBatch.from_arrays([part.column(key), *[pa.array(c, spans) for c in columns]], [key, "base", "added"])

    found = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, base {found}, added {found}")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping ones the first, then the longest."""
    out, at = [], 0
    for a, b, k in sorted(((a, b, k) for k, a, b in spans), key=lambda s: (s[0], -s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
            at = b
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: counts and digest are of the rules' matches; spans has all, n_added those of the network."""
    found = find(table(spark, sf_dir, "documents"))
    place = {k: i for i, k in enumerate(KINDS)}
    order = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])

    def line(spans: F.Column) -> F.Column:
        keyed = F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("k"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("kind")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(line(F.col("base")), 256).alias("base_sha256"),
        line(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )

"""Personal data: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

KINDS = ("email", "phone", "ip", "card", "secret", "ssn", "iban")
TAGS = len(KINDS) + 1  # 0 is none of them
WINDOW, OVERLAP = 512, 64
#: characters of a text that are looked at together, and how far beyond them
PART, BEYOND = 4 << 20, 1024
VOCAB = 103


@lru_cache(1)
def _classes() -> np.ndarray:
    """A small number for each character: ASCII as it is, other letters, digits, blanks and the rest as classes."""
    out = np.full(0x110000, 99, np.uint8)
    for c in range(0x30000):
        x = chr(c)
        out[c] = c - 32 if 32 <= c < 127 else 95 if x.islower() else 96 if x.isupper() else 97 if x.isalpha() else 98 if x.isdigit() else 0 if x.isspace() or c < 32 else 99
    return out


def codes(text: str) -> np.ndarray:
    return _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


# --- labelled spans

DIGITS = "0123456789"
#: the decimal digits of other scripts: Arabic, Persian, Devanagari, Bengali, Thai, full width
SCRIPTS = [[chr(z + k) for k in range(10)] for z in (0x660, 0x6F0, 0x966, 0x9E6, 0xE50, 0xFF10)]
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _example(r: random.Random, kind: str, words: list[str]) -> str:
    digits = r.choice(SCRIPTS) if kind in ("phone", "card", "ssn") and r.random() < 0.1 else DIGITS
    d = lambda n: "".join(r.choice(digits) for _ in range(n))
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    word = lambda: re.sub(r"[^\w]|\d", "", r.choice(words)).lower() or some(LETTERS, 5)
    sep = r.choice(["-", " ", ".", "/"])
    if kind == "email":
        parts = [r.choice([word(), word()[:1], word() + d(r.randint(1, 4)), d(r.randint(1, 6)), some(LETTERS, r.randint(1, 9))]) for _ in range(r.randint(1, 3))]
        host = [r.choice([word(), some(LETTERS, r.randint(2, 9)), word() + d(r.randint(1, 3)), f"{word()}-{word()}"]) for _ in range(r.randint(1, 3))]
        return r.choice([".", "_", "-", "+", "."]).join(parts) + "@" + ".".join(host) + "." + r.choice(["com", "org", "net", "edu", "info", some(LETTERS, 2), some(LETTERS, 2), some(LETTERS, r.randint(3, 7))])
    if kind == "phone":
        code = r.choice(["", "", f"+{d(r.randint(1, 3))}{r.choice(' -.')}", f"00{d(2)} ", f"+{d(2)}", f"{d(1)}-"])
        area = r.choice(["{}", "({})", "({})", "0{}"]).format(d(r.randint(2, 4)))
        groups = [d(r.randint(2, 4)) for _ in range(r.randint(2, 3))]
        return code + area + r.choice([sep, " "]) + sep.join(groups)
    if kind == "ip":
        if r.random() < 0.15:
            return ":".join(some("0123456789abcdef", r.randint(1, 4)) for _ in range(r.randint(6, 8)))
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        n = d(r.choice([13, 14, 15, 16, 16, 16, 17, 18, 19]))
        return r.choice([n, r.choice(" -").join(n[k : k + 4] for k in range(0, len(n), 4))])
    if kind == "secret":
        n = r.randint(20, 64)
        body = r.choice([some("0123456789abcdef", n), some("0123456789ABCDEF", n), some(LETTERS + LETTERS.upper() + DIGITS, n), some(LETTERS + LETTERS.upper() + DIGITS + "+/-_", n), some(LETTERS.upper() + DIGITS, n)])
        return r.choice(["", "", f"{some(LETTERS, r.randint(2, 4))}{r.choice('-_')}"]) + body
    if kind == "ssn":
        return r.choice(["-", "-", " "]).join([d(3), d(2), d(4)])
    n = r.randint(13, 28)
    body = r.choice([some(DIGITS, n), some(LETTERS.upper(), 4) + some(DIGITS, n - 4)])
    full = some(LETTERS.upper(), 2) + some(DIGITS, 2) + body
    return r.choice([full, " ".join(full[k : k + 4] for k in range(0, len(full), 4))])


def _decoy(r: random.Random, words: list[str]) -> str:
    """What isn't personal but has digits or marks: dates, times, amounts, versions, numbers, links, references."""
    d = lambda n: "".join(r.choice(DIGITS) for _ in range(n))
    w = lambda: r.choice(words)
    # acronyms, alone, joined, and with numbers and versions behind them
    acronym = r.choice("- /").join("".join(r.choice(LETTERS.upper()) for _ in range(r.randint(2, 5))) for _ in range(r.randint(1, 3)))
    if r.random() < 0.15:
        return acronym + r.choice(["", " ", "-", "/"]) + r.choice([d(1), d(2), d(r.randint(3, 5)), f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.", f"v{d(1)}", ""])
    return r.choice([
        str(r.randint(1000, 2100)), f"{d(1)}.{d(r.randint(1, 3))}", f"{d(r.randint(1, 2))}.", d(r.randint(1, 9)), f"{d(r.randint(1, 3))},{d(3)}", f"{d(1)}.{d(3)}.{d(3)}", f"{r.choice('$€£')}{d(r.randint(1, 4))}.{d(2)}", f"{r.randint(1900, 2100)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2100)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2100)}",
        f"{r.randint(0, 23)}:{d(2)}", f"{r.randint(0, 23)}:{d(2)}:{d(2)}", f"v{d(1)}.{d(1)}.{d(1)}", f"{w()} {d(1)}.{d(1)}", f"{w()} {d(2)}", f"#{d(r.randint(1, 5))}", f"@{w()}", f"{w()} @ {w()}", f"{d(2)}%", f"{d(1)}x{d(2)}", f"({d(r.randint(1, 4))})", f"[{d(r.randint(1, 2))}]", f"http://{w()}.{w()}.com/{w()}/{d(3)}", f"www.{w()}.org", f"{w()}{d(2)}", f"{w()}-{d(1)}.{d(1)}",
        f"{d(3)} {w()} {d(4)}", f"No. {d(4)}", f"{d(1)}th", f"{d(3)}.{d(2)}", f"{w()}_{w()}_{w()}", f"{w().upper()} {w().upper()}", f"{w()}/{w()}/{w()}", f"{d(2)}-{d(2)}", f"{d(4)}-{d(4)}", f"{w()}={w()}", f"{w()}: {w()}", f"{w()} " * r.randint(2, 20), "-" * r.randint(3, 20), r.choice("=*#.|&%$!?") * r.randint(2, 12),
    ])


def labelled(texts: list[str], rows: int, length: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(characters, tags), ``rows`` windows each: passages of ``texts`` with spans of each kind and decoys put in.

    A third of the windows have passages only.
    """
    r = random.Random(seed)
    texts = [t for t in texts if len(t.split()) > 3] or ["the quick brown fox jumps over the lazy dog and it was not seen again that day in the town"]
    split = [t.split() for t in texts]
    words = [w for t in split for w in t]
    x, y = np.zeros((rows, length), np.int32), np.zeros((rows, length), np.int8)
    for k in range(rows):
        parts: list[str] = []
        tags: list[int] = []
        upper, bare = r.random() < 0.1, r.random() < 0.33
        noise = r.choice(["", "", "", "", "", "!!", "$$$", "###", " |", "***"])

        def add(s: str, tag: int):
            parts.append(s)
            tags.extend([tag] * len(s))

        skip = r.randint(0, 40)
        source, at = r.choice(split), 0
        while len(tags) < length + skip:
            for _ in range(r.randint(1, 9)):  # a stretch of a passage, as it stands
                if at == 0 or at >= len(source):
                    source = r.choice(split)
                    at = r.randrange(len(source))
                w, at = source[at], at + 1
                u = r.random()
                # words of letters at will stand for those the passages don't have
                w = w if u < 0.9 else w.title() if u < 0.95 else "".join(r.choice(LETTERS) for _ in range(r.randint(1, 10)))
                add(w + noise + (" " if r.random() < 0.96 else "\n"), 0)
            what = 1 if bare else r.random()
            if what < 0.5:
                n = r.randrange(len(KINDS))
                if KINDS[n] == "secret" and r.random() < 0.6:
                    add(r.choice(["token", "api_key", "apikey", "password", "passwd", "secret", "key", "auth"]) + r.choice(["=", ": ", " = ", ':"', "='", ' = "', '="']), 0)
                add(_example(r, KINDS[n], words), n + 1)
                add(r.choice([" ", " ", " ", ". ", ", ", '" ', "\n", noise + " ", "; ", ") "]), 0)
            elif what < 0.85:
                add(_decoy(r, words) + r.choice([" ", ", ", ". ", noise + " "]), 0)
        out = "".join(parts)
        if upper:
            out = out.upper() if len(out.upper()) == len(out) else out
        x[k], y[k] = codes(out)[skip : skip + length], tags[skip : skip + length]
    return x, y


# --- the network


class Network:
    """Both directions are computed side by side; the embedding and the input weights are one table."""

    def __init__(self, hidden: int = 20, seed: int = 0):
        r = np.random.default_rng(seed)
        H = self.hidden = hidden
        f = lambda *s, k: r.normal(0, k, s).astype(np.float32)
        self.p = {"X": f(2 * VOCAB, 4 * H, k=0.3), "U": f(2, H, 4 * H, k=0.3), "b": np.zeros((2, 1, 4 * H), np.float32), "P": f(2, H, TAGS, k=0.3), "q": np.zeros(TAGS, np.float32), "A": f(TAGS, TAGS, k=0.1)}
        self.p["b"][:, :, H : 2 * H] = 1

    def forward(self, x: np.ndarray, keep: bool = False):
        """Scores (T, B, tags) of characters x (B, T)."""
        H, p = self.hidden, self.p
        ids = np.stack([x.T, x.T[::-1] + VOCAB])
        T, B = ids.shape[1:]
        table = p["X"] + np.repeat(p["b"][:, 0], VOCAB, axis=0)
        table[:, : 3 * H] *= 0.5
        U = p["U"].copy()
        U[:, :, : 3 * H] *= 0.5
        h, c = np.zeros((2, B, H), np.float32), np.zeros((2, B, H), np.float32)
        hs, kept = np.empty((2, T, B, H), np.float32), []
        for t in range(T):
            a = np.tanh(table[ids[:, t]] + h @ U)
            a[..., : 3 * H] *= 0.5
            a[..., : 3 * H] += 0.5
            before = c
            c = a[..., H : 2 * H] * c + a[..., :H] * a[..., 3 * H :]
            tc = np.tanh(c)
            if keep:
                kept.append((a, before, tc, h))
            h = a[..., 2 * H : 3 * H] * tc
            hs[:, t] = h
        hs[1] = hs[1, ::-1].copy()
        scores = hs[0] @ p["P"][0] + hs[1] @ p["P"][1] + p["q"]
        return (scores, hs, kept, ids) if keep else scores

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss per character and gradients of the CRF's likelihood."""
        H, p = self.hidden, self.p
        s, hs, kept, ids = self.forward(x, keep=True)
        T, B, K = s.shape
        E = np.exp(p["A"])
        # forward and backward sums, scaled at each step
        alpha, beta, scale = np.empty_like(s), np.empty_like(s), np.empty((T, B, 1), np.float32)
        m = s.max(axis=2, keepdims=True)
        e = np.exp(s - m)
        for t in range(T):
            a = e[t] if t == 0 else (alpha[t - 1] @ E) * e[t]
            scale[t] = a.sum(axis=1, keepdims=True)
            alpha[t] = a / scale[t]
        beta[-1] = 1
        for t in range(T - 1, 0, -1):
            beta[t - 1] = (beta[t] * e[t]) @ E.T / scale[t]
        gold = y.T.astype(np.int64)
        rows = np.arange(B)
        score = s[np.arange(T)[:, None], rows, gold].sum() + p["A"][gold[:-1], gold[1:]].sum()
        loss = float((np.log(scale) + m).sum() - score)
        ds = alpha * beta
        ds[np.arange(T)[:, None], rows, gold] -= 1
        both = np.einsum("tbi,tbj->ij", alpha[:-1], beta[1:] * e[1:] / scale[1:]) * E
        np.subtract.at(both, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["A"], g["q"] = both.astype(np.float32), ds.sum(axis=(0, 1))
        g["P"] = np.stack([np.tensordot(hs[k], ds, ((0, 1), (0, 1))) for k in (0, 1)])
        dh = np.stack([ds @ p["P"][0].T, (ds @ p["P"][1].T)[::-1]])
        hb, cb = np.zeros((2, B, H), np.float32), np.zeros((2, B, H), np.float32)
        dzs = np.empty((2, T, B, 4 * H), np.float32)
        UT = p["U"].transpose(0, 2, 1)
        for t in range(T - 1, -1, -1):
            a, before, tc, h = kept[t]
            i, f, o, u = (a[..., k * H : (k + 1) * H] for k in range(4))
            d = dh[:, t] + hb
            dc = d * o * (1 - tc * tc) + cb
            dz = dzs[:, t]
            dz[..., :H] = dc * u * i * (1 - i)
            dz[..., H : 2 * H] = dc * before * f * (1 - f)
            dz[..., 2 * H : 3 * H] = d * tc * o * (1 - o)
            dz[..., 3 * H :] = dc * i * (1 - u * u)
            g["U"] += h.transpose(0, 2, 1) @ dz
            cb, hb = dc * f, dz @ UT
        flat = dzs.reshape(-1, 4 * H)
        np.add.at(g["X"], ids.ravel(), flat)
        g["b"] = dzs.sum(axis=(1, 2))[:, None]
        n = T * B
        return loss / n, {k: v / n for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, *, steps: int, batch: int = 48, rate: float = 0.01, seed: int = 0) -> Network:
        """Adam, with steps that shrink towards the end."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for n in range(1, steps + 1):
            rows = r.integers(0, len(x), batch)
            _, g = self.gradients(x[rows], y[rows])
            norm = max(1.0, float(np.sqrt(sum((a * a).sum() for a in g.values()))) / 0.5)
            for k, a in g.items():
                a = a / norm
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] -= (rate * (1 - 0.95 * n / steps) * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
        return self

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (T, tags, B) of characters x (B, T), as :meth:`forward` but several times faster: both directions one
        after the other, with characters in rows and windows in columns, in place.
        """
        H, p = self.hidden, self.p
        B, T = x.shape
        out = np.empty((T, TAGS, B), np.float32)
        a, z = np.empty((4 * H, B), np.float32), np.empty((4 * H, B), np.float32)
        tmp, hs = np.empty((H, B), np.float32), np.empty((T, H, B), np.float32)
        for way in (0, 1):
            table = p["X"][way * VOCAB : (way + 1) * VOCAB] + p["b"][way, 0]
            U = p["U"][way].copy()
            table[:, : 3 * H] *= 0.5
            U[:, : 3 * H] *= 0.5
            table, U = np.ascontiguousarray(table.T.astype(np.float32)), np.ascontiguousarray(U.T)
            h, c = np.zeros((H, B), np.float32), np.zeros((H, B), np.float32)
            for t in range(T) if way == 0 else range(T - 1, -1, -1):
                np.take(table, x[:, t], axis=1, out=a, mode="clip")
                np.matmul(U, h, out=z)
                a += z
                np.tanh(a, out=a)
                g = a[: 3 * H]
                g *= 0.5
                g += 0.5
                c *= a[H : 2 * H]
                np.multiply(a[:H], a[3 * H :], out=tmp)
                c += tmp
                np.tanh(c, out=tmp)
                h = hs[t]
                np.multiply(a[2 * H : 3 * H], tmp, out=h)
            P = np.ascontiguousarray(p["P"][way].T)
            if way == 0:
                np.matmul(P, hs, out=out)
            else:
                out += np.matmul(P, hs)
        out += p["q"][:, None]
        return out

    def reach(self) -> float:
        """How far the other tags may score below 0 at each character of a stretch that the best way still takes for one of theirs, at most."""
        A = self.p["A"] - self.p["A"][0, 0]
        return float(max(0.0, A[1:, 1:].max(), A[0, 1:].max() + A[1:, 0].max()))

    def decode(self, s: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The best tags (B, T) by Viterbi for scores s (T, B, tags), of which the first ``length`` count; tag 0 on both sides."""
        A = self.p["A"]
        T, B, K = s.shape
        back = np.empty((T, B, K), np.int8)
        best = s[0] + A[0]
        ends = np.zeros((B, K), np.float32)
        for t in range(T):
            if t:
                z = best[:, :, None] + A
                back[t] = z.argmax(axis=1)
                best = z.max(axis=1) + s[t]
                best -= best.max(axis=1, keepdims=True)  # sums over long texts would lose what decides
            last = length == t + 1
            ends[last] = best[last] + A[:, 0]
        out = np.zeros((T, B), np.int8)
        rows = np.arange(B)
        now = ends.argmax(axis=1)
        for t in range(T - 1, -1, -1):
            here = t < length
            out[t, here] = now[here]
            if t:
                now = np.where(here, back[t, rows, now], now)
        return out.T


def fitted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 400, passage: int = 2000, spans: int = 9000, steps: int = 900, hidden: int = 10) -> Network:
    """A network trained on ``spans`` windows of labelled spans, made of passages of at most ``train_rows`` documents.

    The documents are those without a digit or @, and so without personal data, whose ids hash lowest; of each a
    passage of ``passage`` characters at a place that depends on the id. No label of the tables is used.
    """
    text = column(text_col)
    rows = docs.where(text.isNotNull() & ~text.rlike(r"[\p{N}@]")).select(column(id_col).alias("id"), text.alias("text"))
    # ids are ranked first, or every task would send as many texts to the driver
    chosen = rows.select("id").where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(train_rows)
    at = F.pmod(F.xxhash64("id", F.lit(3)), F.greatest(F.lit(1), F.length("text") - passage)).cast("int") + 1
    rows = rows.join(F.broadcast(chosen), "id").select("id", F.substring("text", at, F.lit(passage)).alias("text"))
    texts = [r["text"] for r in rows.groupBy("id").agg(F.min("text").alias("text")).orderBy("id").collect()]
    x, y = labelled(texts, spans, 96)
    return Network(hidden).fit(x, y, steps=steps)


# --- whole texts


def _windows(length: int) -> list[int]:
    """Starts of windows of WINDOW characters that overlap by OVERLAP; the last one ends with the text."""
    if length <= WINDOW:
        return [0]
    return [*range(0, length - WINDOW, WINDOW - OVERLAP), length - WINDOW]


def scores(net: Network, parts: list[np.ndarray], chunk: int = 768) -> list[np.ndarray]:
    """Scores (length, tags) of each text's characters, reconciled over all its windows.

    Where windows overlap each one's scores count by how far the character is from the window's edge.
    """
    jobs = [(k, s) for k, part in enumerate(parts) for s in _windows(len(part))]
    jobs.sort(key=lambda j: min(WINDOW, len(parts[j[0]])))  # windows of like length go together
    out = [np.zeros((len(part), TAGS), np.float32) for part in parts]
    weight = [np.zeros(len(part), np.float32) for part in parts]
    edge = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
    for at in range(0, len(jobs), chunk):
        some = jobs[at : at + chunk]
        size = [min(WINDOW, len(parts[k]) - s) for k, s in some]
        x = np.zeros((len(some), max(size)), np.uint8)
        for r, ((k, s), n) in enumerate(zip(some, size)):
            x[r, :n] = parts[k][s : s + n]
        e = net.emissions(x).transpose(2, 0, 1)
        for r, ((k, s), n) in enumerate(zip(some, size)):
            if n == len(parts[k]):
                out[k], weight[k] = np.ascontiguousarray(e[r, :n]), None
            else:
                w = edge[:n]
                out[k][s : s + n] += e[r, :n] * w[:, None]
                weight[k][s : s + n] += w
    return [o if w is None else o / np.maximum(w, 1)[:, None] for o, w in zip(out, weight)]


def tagged(net: Network, found: list[np.ndarray], margin: int = 64) -> list[list[tuple[int, int, int]]]:
    """[(start, end, tag)] of each text, by the best way through all its scores.

    Where tag 0 leads by more than any transition can make up (:meth:`Network.reach`), no other tag can stand alone; only
    the stretches around other characters are decoded, with a margin.
    """
    reach = net.reach()
    pieces: list[tuple[int, int, int]] = []
    for k, s in enumerate(found):
        hot = np.flatnonzero(s[:, 1:].max(axis=1) - s[:, 0] + reach > 0) if len(s) else np.zeros(0, np.int64)
        if len(hot):
            cut = np.flatnonzero(np.diff(hot) > 2 * margin)
            for a, b in zip(hot[np.append(0, cut + 1)], hot[np.append(cut, len(hot) - 1)]):
                pieces.append((k, max(0, int(a) - margin), min(len(s), int(b) + margin + 1)))
    pieces.sort(key=lambda p: p[2] - p[1])
    out: list[list[tuple[int, int, int]]] = [[] for _ in found]
    at = 0
    while at < len(pieces):
        longest = pieces[min(at + 63, len(pieces) - 1)]
        some = pieces[at : at + 64]
        at += 64
        length = np.array([b - a for _, a, b in some])
        s = np.zeros((longest[2] - longest[1], len(some), TAGS), np.float32)
        for r, (k, a, b) in enumerate(some):
            s[: b - a, r] = found[k][a:b]
        for (k, a, _), n, tags in zip(some, length, net.decode(s, length)):
            edge = np.flatnonzero(np.diff(tags[:n])) + 1
            for i, j in zip(np.append(0, edge), np.append(edge, n)):
                if tags[i]:
                    out[k].append((a + int(i), a + int(j), int(tags[i])))
    return [sorted(x) for x in out]


def find(net: Network, texts: list[str | None], at_once: int = 1 << 20) -> list[list[tuple[int, int, str]]]:
    """[(start, end, kind)] of each text; every character of every text is read by the network.

    Windows are reconciled over the whole text (:func:`scores`) and the best tags found over it (:func:`tagged`).
    Of a text of more than PART characters a part at a time is held, with BEYOND more; spans that begin in a part are
    those it finds.
    """
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    held: list[tuple[int, int, int, int, np.ndarray]] = []

    def flush() -> None:
        for (k, lead, a, b, _), spans in zip(held, tagged(net, scores(net, [x[-1] for x in held]))):
            found[k] += [(lead + i, lead + j, KINDS[tag - 1]) for i, j, tag in spans if a <= lead + i < b]
        held.clear()

    count = 0
    for k, text in enumerate(texts):
        for a in range(0, len(text or ""), PART):
            lead = max(0, a - BEYOND)
            part = codes(text[lead : a + PART + BEYOND])
            if held and count + len(part) > at_once:
                flush()
                count = 0
            held.append((k, lead, a, a + PART, part))
            count += len(part)
    if held:
        flush()
    return found


def find_pii(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, kind): every span of personal data, in characters of the whole text; one scan, no shuffle.

    Null and empty texts have none. A repeated row reports its spans again, whatever other rows have its id; a null id
    is reported as null.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *s) for k, spans in enumerate(find(net, batch.column(1).to_pylist())) for s in spans]
            at = pa.array([r[0] for r in rows], pa.int64())
            cols = [batch.column(0).take(at), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.string())))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "start", "end", "kind"])

    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, start int, end int, kind string").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, net: Network, *, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data in its text replaced by its kind in angle brackets.

    Null and empty texts stay as they are, and so do all other columns; repeated rows are treated alike.
    """
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where).to_pylist()
            for k, spans in enumerate(find(net, texts)):
                for a, b, kind in reversed(spans):
                    texts[k] = f"{texts[k][:a]}<{kind}>{texts[k][b:]}"
            yield batch.set_column(where, batch.schema.field(where), pa.array(texts, batch.schema.field(where).type))

    return docs.mapInArrow(run, docs.schema)

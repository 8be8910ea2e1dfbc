"""Personal data: exact base patterns, and a character-level BiLSTM with CRF transitions for what they miss.

Base spans are the leftmost non-overlapping matches of four patterns, found in linear time. The model is
trained in numpy from labelled spans (:func:`labelled_examples`, seeded): the base forms, written variants that
the patterns miss (spaced or bracketed signs, dotted cards, national numbers), spelt-out forms ("name at host dot
com", numbers digit by digit in words), and credentials, a kind of its own (``secret``) that no pattern knows.

It reads the surroundings of every trigger in the whole text, in overlapping windows. A trigger is a digit, an
"@", a run of digits in words, or an "at" with a "dot" behind it: every form that is labelled has one (a test
holds the generator to that), so no other place can hold a span that the model knows. Windows are decoded by
Viterbi and reconciled over the whole text: a span seen by several windows is taken from the one where it lies
furthest inside, and of spans that overlap the one with the larger margin to "outside" wins. Model spans must
hold what their kind holds (digits, checksum, signs said in words) and never touch a base span; base spans always stay.

Null texts are empty and, like texts without a trigger, have no spans. Each row is its own: repeated rows, ids that
are shared or null change nothing; no rows give no rows. Very long texts are read whole. Offsets are code
points, ends are exclusive. detect() reads doc_id and text alone, masked() keeps all other columns as they are.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.batches import put_away, slices

KINDS = ("email", "ip", "card", "phone")
#: What the model finds: the base kinds, then its own.
MODEL_KINDS = (*KINDS, "secret")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT_OR_AT = re.compile("[0-9@]")
#: The digits in words.
SAID = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
WORD = "(?:" + "|".join(SAID) + ")"
TRIGGER = re.compile(rf"[0-9@]+|(?i:\b{WORD}(?:[ -]{WORD}){{3,}}\b|\bat\b(?=.{{1,64}}\bdot\b)|\bdot\b)")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then by start."""
    if not DIGIT_OR_AT.search(text):
        return []
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append(("email", lo, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(MODEL_KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


#: Words between the spans of training texts, so that the model meets more than invented ones.
COMMON = (
    "the of and to in is was for on with as by at from or that this be are it you we he she they his her have has had will can please not but all one two when who what there here "
    "my your our their now then ok me so if out up was am pm dot log server mail phone card number call write reach contact send paid used after before until last next first "
    "der die das und ist nicht ein eine mit von zu bitte an oder auf schreiben mein wir ich er sie "
    "le la les et est pas un une avec de du vous nous ou sur il elle mon appelez el los y es no con por para una su mi llame o"
).split()


def labelled_examples(n: int = 6000, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with labelled spans: the base forms, written and spelt-out variants that the patterns miss, credentials, and numbers that are nothing."""
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word(lo: int = 2, hi: int = 9) -> str:
        made = "".join(letters[i] for i in rng.integers(0, 26, rng.integers(lo, hi)))
        return made if made not in ("at", "dot") else "a" + made

    def context() -> str:
        return COMMON[rng.integers(0, len(COMMON))] if rng.random() < 0.6 else word()

    def digits(k: int) -> str:
        few = rng.integers(0, 10, 1 + rng.integers(0, 2)) if rng.random() < 0.2 else np.arange(10)
        return "".join(map(str, rng.choice(few, k)))

    def card() -> str:
        d = str(rng.integers(3, 7)) + digits(14)
        return next(d + str(c) for c in range(10) if luhn(d + str(c)))

    names = list(SAID)

    def said(x: str) -> str:
        return " ".join(names[int(c) + 1 if c != "0" else int(rng.integers(0, 2))] for c in x if c.isdigit())

    def any_case(x: str) -> str:
        v = rng.random()
        return x if v < 0.8 else x.upper() if v < 0.9 else x.capitalize()

    def value(kind: str) -> str:
        v = rng.random()
        if kind == "email":
            who, host = f"{word()}{rng.choice(['', '.', '_'])}{word()}{rng.choice(['', digits(2)])}", f"{word()}{rng.choice(['', '.' + word(), digits(1)])}.{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"
            if v < 0.4:
                return any_case(f"{who}@{host}")
            if v < 0.6:
                return f"{who} @ {host}" if v < 0.5 else f"{who}@{host.replace('.', ' . ')}"
            at, dot = [(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" AT ", " DOT "), ("(at)", ".")][rng.integers(0, 5)]
            return any_case(f"{who.replace('.', dot) if dot != '.' else who}{at}{host.replace('.', dot)}") if at != "(at)" else f"{who}{at}{host.replace('.', ' dot ')}"
        if kind == "ip":
            parts = [str(x) for x in rng.integers(1, 256, 4)]
            return ".".join(parts) if v < 0.5 else " . ".join(parts) if v < 0.7 else "[.]".join(parts) if v < 0.85 else " dot ".join(parts)
        if kind == "card":
            d = card()
            four = [d[i : i + 4] for i in range(0, 16, 4)]
            return d if v < 0.3 else " ".join(four) if v < 0.5 else ".".join(four) if v < 0.65 else " - ".join(four) if v < 0.8 else any_case(said(d))
        if kind == "secret":
            d = "".join(rng.choice(list("0123456789abcdef"), int(rng.choice([32, 40, 64])))) if v < 0.5 else "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), int(rng.integers(20, 44))))
            return d if any(c.isdigit() for c in d) and any(c.isalpha() for c in d) else "a1" + d
        area, a, b = digits(3), digits(3), digits(4)
        if v > 0.85:
            return any_case(f"{rng.choice(['', 'plus '])}{said(rng.choice(['1', '49', '33']) + area + a + b)}")
        return f"+1 ({area}) {a}-{b}" if v < 0.35 else f"+{rng.integers(20, 99)} {area} {a} {b}" if v < 0.5 else f"({area}) {a}-{b}" if v < 0.7 else f"00{rng.integers(20, 99)} {area} {a} {b}"

    def before(kind: str) -> tuple[str, str]:
        """What stands before and behind the span, and is not of it."""
        if kind != "secret":
            return "", ""
        quote = str(rng.choice(["", '"', "'"]))
        key = any_case(str(rng.choice(["token", "api_key", "apikey", "secret", "password", "access_token", "client_secret", "auth_token", "api key", "private_key"])))
        return key + str(rng.choice([" = ", "=", ": ", ":"])) + quote, quote

    def nothing() -> str:
        hexed = hashlib.sha256(digits(9).encode()).hexdigest()
        plain = [
            digits(int(rng.integers(1, 9))), f"{digits(1)}.{digits(2)}", f"19{digits(2)}-0{rng.integers(1, 10)}-1{rng.integers(0, 10)}", f"version {digits(1)}.{digits(1)}.{digits(1)}",
            f"no. {digits(12)}", f"{digits(2)}:{digits(2)}", "@" + word(), f"${digits(3)}.{digits(2)}", f"commit {hexed[:40]}", f"sha256 {hexed}", f"{word()}/{hexed[:32]}.png",
            f"token of {digits(3)}", f"at {context()} the dot {context()}", f"at the dot of {context()}", f"a dot at {digits(2)}", f"{context()} at {context()} {context()}", f"at {digits(2)} on the dot", f"{said(digits(int(rng.integers(4, 7))))}", f"one or two {word()}", f"secret {word()} {digits(4)}", f"password {word()}", f"id={hexed[:24]}",
        ]
        return plain[rng.integers(0, len(plain))]

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(1, 4)):
            text += " ".join(context() for _ in range(rng.integers(1, 6))) + " "
            kind = str(rng.choice([*MODEL_KINDS, "none", "none"]))
            got = nothing() if kind == "none" else value(kind)
            head, tail = before(kind)
            if kind != "none":
                spans.append((kind, len(text + head), len(text + head) + len(got)))
            text += head + got + tail + str(rng.choice([" ", ", ", ". ", "\n"]))
        out.append((text + " ".join(context() for _ in range(rng.integers(0, 4))), spans))
    return out


TAGS = 1 + 2 * len(MODEL_KINDS)  # outside; then begin and inside of each kind
CHARS = 128 + 4


def char_ids(text: str) -> np.ndarray:
    """ASCII as it is; other characters by their case or kind."""
    x = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    for i in np.flatnonzero(x >= 128):
        c = chr(x[i])
        x[i] = 128 + (1 if c.islower() else 2 if c.isupper() else 3 if c.isspace() else 0)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Embedding, LSTM in both directions, linear scores, CRF. Arrays are (time, batch, width); masks hide the padding."""

    def __init__(self, embed: int = 12, hidden: int = 24, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.h = hidden
        n = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": n(CHARS, embed) * 3, "o": n(2 * hidden, TAGS), "ob": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": n(embed + hidden, 4 * hidden), f"b{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)}
        # an inside tag follows its own begin or inside alone
        self.allowed = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(MODEL_KINDS)):
            bad = np.ones(TAGS, bool)
            bad[[1 + 2 * k, 2 + 2 * k]] = False
            self.allowed[bad, 2 + 2 * k] = -1e4
        self.start = np.where([t and t % 2 == 0 for t in range(TAGS)], -1e4, 0.0).astype(np.float32)

    def _lstm(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        w, b, hid = self.p["w" + d], self.p["b" + d], self.h
        h = c = np.zeros((x.shape[1], hid), np.float32)
        out = np.empty((*x.shape[:2], hid), np.float32)
        for t in range(len(x)):
            z = np.concatenate([x[t], h], axis=1)
            a = z @ w + b
            i, f, o = (_sigmoid(a[:, k * hid : (k + 1) * hid]) for k in range(3))
            g = np.tanh(a[:, 3 * hid :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep is not None:
                keep.append((z, i, f, o, g, before, tc))
        return out

    def scores(self, ids: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """ids: (time, batch), padded behind. The backward pass runs over each row turned around within its length."""
        n = len(ids)
        turn = np.where(np.arange(n)[:, None] < lengths, lengths - 1 - np.arange(n)[:, None], np.arange(n)[:, None])
        x = self.p["e"][ids]
        kf, kb = ([], []) if keep is not None else (None, None)
        hf = self._lstm(x, "f", kf)
        hb = np.take_along_axis(self._lstm(np.take_along_axis(x, turn[:, :, None], 0), "b", kb), turn[:, :, None], 0)
        h = np.concatenate([hf, hb], axis=2)
        if keep is not None:
            keep |= {"h": h, "f": kf, "b": kb, "turn": turn, "ids": ids}
        return h @ self.p["o"] + self.p["ob"]

    def _lstm_back(self, dh: np.ndarray, kept: list, d: str, grad: dict) -> np.ndarray:
        w, hid = self.p["w" + d], self.h
        gw, gb = grad["w" + d], grad["b" + d]
        dx = np.empty((len(kept), dh.shape[1], w.shape[0] - hid), np.float32)
        dhn = dc = np.zeros((dh.shape[1], hid), np.float32)
        for t in range(len(kept) - 1, -1, -1):
            z, i, f, o, g, before, tc = kept[t]
            dht = dh[t] + dhn
            dct = dc + dht * o * (1 - tc * tc)
            da = np.concatenate([dct * g * i * (1 - i), dct * before * f * (1 - f), dht * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
            gw += z.T @ da
            gb += da.sum(axis=0)
            dz = da @ w.T
            dx[t], dhn, dc = dz[:, :-hid], dz[:, -hid:], dct * f
        return dx

    def gradients(self, ids: np.ndarray, lengths: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood of the tags for each sequence, and its gradients."""
        keep: dict = {}
        s = self.scores(ids, lengths, keep)
        n, batch = ids.shape
        trans = self.p["t"] + self.allowed
        live = np.arange(n)[:, None] < lengths
        top = lambda x, axis: (m := x.max(axis=axis, keepdims=True), np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis)))[1]
        alpha = np.empty((n, batch, TAGS), np.float32)
        alpha[0] = self.start + s[0]
        for t in range(1, n):
            alpha[t] = np.where(live[t][:, None], top(alpha[t - 1][:, :, None] + trans, 1) + s[t], alpha[t - 1])
        z = top(alpha[-1], 1)
        beta = np.zeros((n, batch, TAGS), np.float32)
        dt = np.zeros_like(trans)
        for t in range(n - 1, 0, -1):
            nxt = s[t] + beta[t]
            inner = trans + nxt[:, None, :]
            beta[t - 1] = np.where(live[t][:, None], top(inner, 2), beta[t])
            pair = np.exp(alpha[t - 1][:, :, None] + inner - z[:, None, None]) * live[t][:, None, None]
            dt += pair.sum(axis=0)
        ds = np.exp(alpha + beta - z[None, :, None]) * live[:, :, None]
        rows = np.arange(batch)
        gold = (self.start[tags[0]] + s[0][rows, tags[0]]).astype(np.float64)
        for t in range(n):
            ds[t, rows, tags[t]] -= live[t]
            if t:
                gold += live[t] * (trans[tags[t - 1], tags[t]] + s[t][rows, tags[t]])
                np.add.at(dt, (tags[t - 1], tags[t]), -live[t].astype(np.float32))
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["t"] = np.where(self.allowed < 0, 0, dt)
        flat = ds.reshape(-1, TAGS).astype(np.float32)
        grad["o"], grad["ob"] = keep["h"].reshape(len(flat), -1).T @ flat, flat.sum(axis=0)
        dh = (flat @ self.p["o"].T).reshape(n, batch, -1)
        dx = self._lstm_back(dh[:, :, : self.h], keep["f"], "f", grad)
        turn = keep["turn"][:, :, None]
        dx = dx + np.take_along_axis(self._lstm_back(np.take_along_axis(dh[:, :, self.h :], turn, 0), keep["b"], "b", grad), turn, 0)
        np.add.at(grad["e"], ids.ravel(), dx.reshape(-1, dx.shape[2]))
        return float((z - gold).sum()), {k: v / batch for k, v in grad.items()}

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (time, batch), and each place's score over "outside"."""
        s = self.scores(ids, lengths)
        n, batch = ids.shape
        trans, live = self.p["t"] + self.allowed, np.arange(n)[:, None] < lengths
        best, back = self.start + s[0], np.zeros((n, batch, TAGS), np.int64)
        for t in range(1, n):
            got = best[:, :, None] + trans
            back[t] = np.where(live[t][:, None], got.argmax(axis=1), np.arange(TAGS))
            best = np.where(live[t][:, None], got.max(axis=1) + s[t], best)
        tags = np.empty((n, batch), np.int64)
        tags[-1] = best.argmax(axis=1)
        for t in range(n - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(back[t], tags[t][:, None], 1)[:, 0]
        return tags, np.take_along_axis(s, tags[:, :, None], 2)[:, :, 0] - s[:, :, 0]


def tags_of(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(len(text), np.int64)
    for kind, lo, hi in spans:
        out[lo:hi] = 2 + 2 * MODEL_KINDS.index(kind)
        out[lo] -= 1
    return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((lengths.max(), len(rows)), np.int64)
    for k, r in enumerate(rows):
        out[: len(r), k] = r
    return out, lengths


@functools.lru_cache(maxsize=4)
def trained(steps: int = 700, batch: int = 48, rate: float = 0.02, seed: int = 5) -> Tagger:
    """Adam over seeded examples; the same model on every call."""
    examples = [(char_ids(t), tags_of(t, s)) for t, s in labelled_examples(seed=seed)]
    rng, model = np.random.default_rng(seed), Tagger()
    m, v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(examples), batch)
        ids, lengths = padded([examples[i][0][:160] for i in pick])
        tags, _ = padded([examples[i][1][:160] for i in pick])
        _, grad = model.gradients(ids, lengths, tags)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            model.p[k] -= (rate * min(1.0, 2 * (1 - step / (steps + 1))) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def unsaid(x: str) -> str:
    """Signs and digits for the words that say them."""
    x = re.sub(r"\s*[\[(]?\s*\bat\b\s*[\])]?\s*", "@", x, flags=re.I)
    x = re.sub(r"\s*[\[(]?\s*\bdot\b\s*[\])]?\s*", ".", x, flags=re.I)
    x = re.sub(r"\bplus\s+", "+", x, flags=re.I)
    return re.sub(rf"\b{WORD}\b", lambda m: SAID[m[0].lower()], x, flags=re.I)


def holds(kind: str, x: str) -> bool:
    if kind == "secret":
        return len(x) >= 16 and bool(re.fullmatch(r"[A-Za-z0-9+/=_.~-]+", x)) and bool(re.search("[0-9]", x)) and bool(re.search("[A-Za-z]", x))
    y = unsaid(x)
    d = _digits(y)
    if kind == "email":
        who, at, host = y.partition("@")
        return bool(re.fullmatch(r"[A-Za-z0-9._%+ -]+", who)) and bool(who.strip()) and at == "@" and "@" not in host and bool(re.search(r"[A-Za-z0-9]\s*\.\s*[A-Za-z]", host))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", y)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[A-Za-z]", y)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and not re.search(r"[A-Za-z]", y)
    return 9 <= len(d) <= 15 and not re.search(r"[A-Za-z]", y) and (y != x or bool(re.match(r"[+(]|00", y)))


def windows(text: str, reach: int = 40, size: int = 640, step: int = 320) -> list[tuple[int, int]]:
    """Overlapping windows over all surroundings of triggers.

    An area reaches ``reach`` characters and to the far ends of the non-space runs before and after its trigger.
    What lies in an area and is at most ``size - step`` long lies whole in one window: an address has at most
    254 characters, which leaves room for 33 dots or signs with a space on either side.
    """
    runs = [m.span() for m in re.finditer(r"\S+", text)]
    starts, ends = [r[0] for r in runs], [r[1] for r in runs]
    areas: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        # the run that ends before the trigger or holds its start, and the one that begins after it or holds its end
        before = text[m.start() - 1 : m.start()].strip() != ""
        after = text[m.end() : m.end() + 1].strip() != ""
        at = bisect.bisect_right(starts, m.start()) - 1
        first, last = max(0, at if before else at - 1), min(len(runs) - 1, at if after else at + 1)
        lo, hi = min(max(0, m.start() - reach), starts[first]), max(min(len(text), m.end() + reach), ends[last])
        while areas and lo <= areas[-1][1]:
            lo, hi = min(lo, areas[-1][0]), max(hi, areas.pop()[1])
        areas.append([lo, hi])
    out = []
    for lo, hi in areas:
        while hi - lo > size:
            out.append((lo, lo + size))
            lo += step
        out.append((lo, hi))
    return out


def model_spans(texts: list[str], model: Tagger, batch: int = 256) -> list[list[tuple[str, int, int]]]:
    """Reconciled model spans of each text."""
    jobs = [(k, lo, hi) for k, t in enumerate(texts) for lo, hi in windows(t)]
    jobs.sort(key=lambda j: (j[2] - j[1], j))
    seen: list[dict] = [{} for _ in texts]
    at = 0
    while at < len(jobs):
        # padded batches of at most the characters of ``batch`` windows of 192
        part = jobs[at : at + batch]
        part = part[: max(1, 192 * batch // (part[-1][2] - part[-1][1]))]
        at += len(part)
        ids, lengths = padded([char_ids(texts[k][lo:hi]) for k, lo, hi in part])
        tags, margin = model.decode(ids, lengths)
        for c, (k, lo, hi) in enumerate(part):
            column, n = tags[: hi - lo, c], hi - lo
            for a in np.flatnonzero(column % 2 == 1):
                b = a + 1
                while b < n and column[b] == column[a] + 1:
                    b += 1
                inside = min(a if lo else n, n - b if hi < len(texts[k]) else n)
                key = (int(column[a]) // 2, lo + int(a), lo + int(b))
                seen[k][key] = max(seen[k].get(key, (-1, 0.0)), (int(inside), float(margin[a:b, c].mean())))
    out = []
    for text, found in zip(texts, seen, strict=True):
        taken: list[tuple[str, int, int]] = []
        for (kind, a, b), _ in sorted(found.items(), key=lambda x: (-min(x[1][0], 16), -x[1][1], x[0])):
            while a < b and text[a].isspace():
                a += 1
            while a < b and text[b - 1] in " \t\n.,;:":
                b -= 1
            if a < b and holds(MODEL_KINDS[kind], text[a:b]) and all(b <= x or y <= a for _, x, y in taken):
                taken.append((MODEL_KINDS[kind], a, b))
        out.append(taken)
    return out


def find(texts: list[str], model: Tagger) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text. What the base patterns matched and failed counts as looked at only where they kept it."""
    base = [base_spans(t) for t in texts]
    return [(b, [s for s in m if all(s[2] <= x or y <= s[1] for _, x, y in b)]) for b, m in zip(base, model_spans(texts, model), strict=True)]


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span's place taken by its kind; of spans that overlap, one mark covers all."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def detect(docs: DataFrame, model: Tagger | None = None, group: int = 500) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added (the model's), n_spans: one row for each of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), group):
                part = pdf.iloc[at : at + group]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                out = []
                for text, (base, added) in zip(texts, find(texts, shared.value), strict=True):
                    spans = base + added
                    out.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(added), len(spans)))
                out = pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield out

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def masked(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """docs with every span of ``text`` replaced by its kind, and ``n_chars``, where there is one, counted anew. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches):
        put_away()
        for batch in batches:
            for rows in slices(batch):
                texts = rows.column(at).to_pylist()
                hidden = [mask(t, b + a) for t, (b, a) in zip((t or "" for t in texts), find([t or "" for t in texts], shared.value), strict=True)]
                field = rows.schema.field(at)
                yield rows.set_column(at, field, pa.array([None if t is None else x for t, x in zip(texts, hidden, strict=True)], field.type))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.fieldNames() else out

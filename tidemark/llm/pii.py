r"""Personal data: base patterns, and a linear-chain CRF over word-shape features on top.

The base patterns always hold. The CRF is trained from a small labelled table and adds
what the patterns miss (local phone numbers, spelled-out addresses, grouped cards). It
is decoded by Viterbi in numpy, many chains at once. A chain is a whole line, of any
length, that holds a candidate (a word with a digit or `@`, or a spelled-out at or dot);
lines without any hold no personal data by definition.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import without

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_chain = re.compile(r"[0-9]+(?:\.[0-9]+)*")
#: The longest address that mail systems carry, in characters.
MAX_EMAIL = 254
#: Words, padding included, that Viterbi decodes at once; a longer segment is a block of its own.
CELLS = 1 << 16
LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
_token = re.compile(r"[^\x20\x09-\x0D]+")
_candidate = re.compile(r"[0-9@]|[(\[{](?:at|dot)[)\]}]|^dot$", re.I)
_spot = re.compile(r"[0-9@]|[(\[{](?:at|dot)[)\]}]|\bdot\b", re.I)
_trim = ".,;:!?\"'»”)]}"
OUT = [f"n_{k}" for k in KINDS] + ["base_spans", "spans", "n_spans"]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _byte_value(part: str) -> bool:
    """Whether a run of ASCII digits, of any length, is a number of 255 at most."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _emails(line: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern: from each `@` back over the local part, then on over the domain.

    No `@` stands in a local part or a domain, so every character is passed a bounded
    number of times, also in runs of a megabyte.
    """
    end, at = 0, line.find("@")
    while at >= 0:
        start = at
        while start > end and line[start - 1] in _LOCAL:
            start -= 1
        domain = _domain.match(line, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = line.find("@", at + 1)


def _addresses(line: str) -> Iterator[tuple[int, int]]:
    """Matches of the ip pattern whose parts are at most 255: a chain of dotted numbers gives its runs of four, in order."""
    for chain in _chain.finditer(line):
        if line.count(".", *chain.span()) < 3:
            continue
        at, parts = chain.start(), chain.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(map(_byte_value, four)):
                yield at, at + size
            at += size + 1


def _cards(line: str) -> Iterator[tuple[int, int]]:
    for m in BASE["card"].finditer(line):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(line: str) -> Iterator[tuple[int, int]]:
    for m in BASE["phone"].finditer(line):
        if 8 <= sum(map(m.group().count, "0123456789")) <= 15:
            yield m.span()


def base_spans(line: str, at: int = 0) -> list[tuple[str, int, int]]:
    """Pattern spans of a line (no pattern crosses \\n), leftmost, not overlapping within a kind; in time linear in its length."""
    out = [("email", at + a, at + b) for a, b in _emails(line)]
    out += [("ip", at + a, at + b) for a, b in _addresses(line)]
    out += [("card", at + a, at + b) for a, b in _cards(line)]
    return out + [("phone", at + a, at + b) for a, b in _phones(line)]


# ---- features

def shape(word: str) -> str:
    """X for upper case, x for lower case, d for digits, other characters as they are; runs collapsed."""
    out = []
    for c in word:
        s = "d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def _features(words: list[str], i: int, cache: dict) -> list[str]:
    def own(w: str) -> list[str]:
        if w not in cache:
            if len(cache) > 200_000:
                cache.clear()
            digits = sum("0" <= c <= "9" for c in w)
            low = w.lower().strip("()[]{}<>.,;:")
            cache[w] = [
                f"s={shape(w)}", f"n={min(digits, 20)}", f"l={min(len(w), 20)}", f"w={low if len(low) < 12 and not digits else '*'}",
                f"a={'@' in w}", f"dots={min(w.count('.'), 5)}", f"t={w[-1:] if not w[-1:].isalnum() else 'x'}",
            ]
        return cache[w]

    out = ["b", *own(words[i])]
    for d in (-2, -1, 1, 2):
        f = own(words[i + d]) if 0 <= i + d < len(words) else ["edge"]
        out += [f"{d}{x}" for x in f[:4]]
    return out


class Crf:
    """Linear-chain CRF; weights of features by name, transitions between labels."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, segments: list[list[str]]) -> list[np.ndarray]:
        cache: dict = {}
        out = []
        for words in segments:
            rows = [[self.index[f] for f in _features(words, i, cache) if f in self.index] for i in range(len(words))]
            out.append(np.stack([self.emit[r].sum(0) for r in rows]))
        return out

    def decode(self, segments: list[list[str]]) -> list[np.ndarray]:
        """Viterbi over all segments together, shorter ones padded."""
        scores = self.scores(segments)
        n, longest, k = len(scores), max(map(len, scores), default=0), len(LABELS)
        lengths = np.array([len(s) for s in scores])
        padded = np.zeros((n, longest, k))
        for i, s in enumerate(scores):
            padded[i, : len(s)] = s
        best, back = padded[:, 0].copy(), np.zeros((n, longest, k), np.int8)
        for t in range(1, longest):
            step = best[:, :, None] + self.move[None]
            back[:, t] = step.argmax(1)
            new = step.max(1) + padded[:, t]
            inside = (t < lengths)[:, None]
            best = np.where(inside, new, best)
        out = np.zeros((n, longest), np.int8)
        last = best.argmax(1)
        for t in range(longest - 1, -1, -1):
            out[:, t] = last
            prev = back[np.arange(n), t, last]
            last = np.where((t < lengths) & (t > 0), prev, last)
        return [out[i, : lengths[i]] for i in range(n)]


def train(segments: list[list[str]], labels: list[list[int]], steps: int = 150, rate: float = 0.15, ridge: float = 2e-3) -> Crf:
    """Maximum likelihood with a ridge penalty, by Adam on the whole (small) table; deterministic."""
    cache: dict = {}
    names = [[_features(w, i, cache) for i in range(len(w))] for w in segments]
    index = {f: i for i, f in enumerate(sorted({f for s in names for t in s for f in t}))}
    n, longest, k = len(segments), max(map(len, segments)), len(LABELS)
    width = max(len(t) for s in names for t in s)
    feats = np.full((n, longest, width), len(index))
    gold = np.zeros((n, longest), int)
    mask = np.zeros((n, longest), bool)
    for i, s in enumerate(names):
        mask[i, : len(s)] = True
        gold[i, : len(s)] = labels[i]
        for t, f in enumerate(s):
            feats[i, t, : len(f)] = [index[x] for x in f]
    emit, move = np.zeros((len(index) + 1, k)), np.zeros((k, k))
    impossible = np.array([[b.startswith("I-") and a[2:] != b[2:] for b in LABELS] for a in LABELS])
    state = [np.zeros_like(x) for x in (emit, emit, move, move)]
    eye = np.eye(k)
    for step in range(1, steps + 1):
        m = np.where(impossible, -1e4, move)
        u = emit[feats].sum(2)
        fwd, bwd = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        fwd[:, 0] = u[:, 0]
        for t in range(1, longest):
            x = fwd[:, t - 1, :, None] + m
            top = x.max(1)
            fwd[:, t] = np.where(mask[:, t, None], top + np.log(np.exp(x - top[:, None]).sum(1)) + u[:, t], fwd[:, t - 1])
        z = fwd[:, -1]
        log_z = z.max(1) + np.log(np.exp(z - z.max(1, keepdims=True)).sum(1))
        for t in range(longest - 2, -1, -1):
            x = m[None] + (u[:, t + 1] + bwd[:, t + 1])[:, None, :]
            top = x.max(2)
            bwd[:, t] = np.where(mask[:, t + 1, None], top + np.log(np.exp(x - top[:, :, None]).sum(2)), 0)
        # fwd past a segment's end repeats its last value, and bwd there is 0
        prob = np.exp(fwd + bwd - log_z[:, None, None]) * mask[:, :, None]
        diff = prob - eye[gold] * mask[:, :, None]
        g_emit = np.zeros_like(emit)
        np.add.at(g_emit, feats.reshape(-1, width), diff.reshape(-1, 1, k))
        g_emit[-1] = 0
        g_move = np.zeros_like(move)
        for t in range(1, longest):
            on = mask[:, t]
            pair = np.exp(fwd[on, t - 1, :, None] + m[None] + (u[on, t] + bwd[on, t])[:, None, :] - log_z[on, None, None])
            g_move += pair.sum(0) - np.einsum("ni,nj->ij", eye[gold[on, t - 1]], eye[gold[on, t]])
        for w, g, at in ((emit, g_emit / n + ridge * emit, 0), (move, g_move / n + ridge * move, 2)):
            state[at] = 0.9 * state[at] + 0.1 * g
            state[at + 1] = 0.99 * state[at + 1] + 0.01 * g * g
            w -= rate * (state[at] / (1 - 0.9**step)) / (np.sqrt(state[at + 1] / (1 - 0.99**step)) + 1e-8)
        emit[-1] = 0
    return Crf(index, emit[:-1], np.where(impossible, -1e4, move))


# ---- the labelled table

# Patterns of the labelled examples. {kind:...} marks an entity, # a digit, ~ a letter.
EXAMPLES = [
    "please call {phone:(###) ###-####} before noon today", "phone {phone:###-###-####} or write to us", "tel {phone:## ## ## ## ##} le matin",
    "her number is {phone:### ### ####} and she waits", "fax {phone:+## ### ### ####} is open", "mobile {phone:0### #######} nach acht",
    "reach him at {phone:+# (###) ###-####} any time", "call {phone:1-###-###-####} now", "telefon {phone:0## / #######} im haus",
    "mail {email:~~~~.##@~~~~.example.com} for more", "write to {email:~~~~@~~~~~.org} soon", "contact {email:~~~~ (at) ~~~~~ (dot) com} please",
    "send it to {email:~~~~~ [at] ~~~~~~ [dot] org} today", "address {email:~~~~ (at) ~~~~.com} works", "reply to {email:~~~~.~~~~ at ~~~~~ dot com} there",
    "the host {ip:##.###.##.###} answered", "from {ip:###.##.#.##} port 80", "server {ip:10.#.##.###} is down", "ping {ip:192.168.#.##} failed",
    "card {card:#### #### #### ####} was charged", "pay with {card:####-####-####-####} here", "visa {card:4###############} expired", "amex {card:3### ###### #####} ok",
    "Version 2.0 of the License", "Licensed under CC BY-NC 4.0.", "General Public License, version 3.", "page 12 of 340 in the book", "in 19## there were ### people",
    "the price is ##.## or ###,### dollars", "from 2001-##-## to 2015-##-##", "chapter #, section #.#.#", "at the end of the day", "key AKIA~~~~#~#~~#~~#~~# was found",
    "password=~#~~##~#~~# is set", "token = \"~##~~#~#~#~~#~##\" in the file", "room ### on floor #", "about ##% of ### items", "order no. ######## was sent",
    "they met at ##:## on the dot", "id ########### in table #", "see (at) the corner", "release #.##.# of the tool", "sha ~#~~##~~##~#~~##~~# ok", "isbn ###-#-##-######-# is old",
]
_entity = re.compile(r"\{(\w+):([^}]*)\}")


def example_table(copies: int = 8, seed: int = 5) -> pd.DataFrame:
    """The small labelled table: text, and spans as (kind, start, end). len(EXAMPLES) * copies rows at most.

    Each copy fills digits and letters anew and draws other words around the example.
    """
    rng = np.random.default_rng(seed)
    letters, rows = "abcdefghijklmnopqrstuvwxyz", []
    filler = [x for e in EXAMPLES for x in _entity.sub("", e).split() if x.isalpha()]

    def fill(s: str) -> str:
        s = "".join(str(rng.integers(10)) if c == "#" else letters[rng.integers(26)] if c == "~" else c for c in s)
        return s

    for _ in range(copies):
        for e in EXAMPLES:
            text, spans = " ".join(rng.choice(filler, rng.integers(0, 5))), []
            text += " " if text else ""
            at = 0
            for m in _entity.finditer(e):
                text += fill(e[at : m.start()])
                start = len(text)
                text += fill(m.group(2))
                spans.append((m.group(1), start, len(text)))
                at = m.end()
            text += fill(e[at:])
            more = " ".join(rng.choice(filler, rng.integers(0, 5)))
            text += ("." if rng.random() < 0.3 else "") + (" " + more if more else "")
            rows.append((text, spans))
    return pd.DataFrame(rows, columns=["text", "spans"])


def _labels_of(text: str, spans) -> tuple[list[str], list[int]]:
    words, labels = [], []
    for m in _token.finditer(text):
        words.append(m.group())
        label = 0
        for kind, start, end in spans:
            if m.start() < end and m.end() > start:
                label = LABELS.index(("B-" if m.start() <= start else "I-") + kind)
        labels.append(label)
    return words, labels


def train_table(table: pd.DataFrame) -> Crf:
    """A model from a labelled table (text, spans)."""
    pairs = [_labels_of(t, s) for t, s in zip(table["text"], table["spans"])]
    return train([w for w, _ in pairs if w], [y for w, y in pairs if w])


# ---- decoding of texts

def _plausible(kind: str, text: str) -> bool:
    digits = sum("0" <= c <= "9" for c in text)
    if kind == "email":
        return len(text) <= MAX_EMAIL and bool(re.search(r"@|[(\[{]at[)\]}]|\bat\b", text, re.I)) and bool(re.search(r"\.|dot", text, re.I))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", text)) and all(map(_byte_value, text.split(".")))
    if kind == "card":
        return 15 <= digits <= 19 and luhn("".join(c for c in text if "0" <= c <= "9"))
    return 7 <= digits <= 15 and bool(re.fullmatch(r"[+0-9(][0-9() ./-]*[0-9]", text))


def _segments(line: str, at: int) -> Iterator[list[tuple[str, int]]]:
    """The line as one chain of (word, position), if any of its words is a candidate."""
    words = [(m.group(), at + m.start()) for m in _token.finditer(line)]
    if any(_candidate.search(w) for w, _ in words):
        yield words


def _near_lines(text: str) -> Iterator[tuple[str, int]]:
    """Lines with a spot that a pattern or the model could start from, and their positions."""
    at = 0
    while m := _spot.search(text, at):
        start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        end = len(text) if end < 0 else end
        yield text[start:end], start
        at = end


def _blocks(order: list[int], segments: list[list]) -> Iterator[list[int]]:
    """Runs of order (shortest segments first) that pad to CELLS words at most."""
    block: list[int] = []
    for j in order:
        if block and (len(block) + 1) * len(segments[j]) > CELLS:
            yield block
            block = []
        block.append(j)
    if block:
        yield block


def find_spans(texts: list[str | None], model: Crf) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, (kind, start, end) by kind as listed, then start."""
    base: list[list] = []
    segments, owner = [], []
    for i, text in enumerate(texts):
        found = []
        for line, at in _near_lines(text or ""):
            found += base_spans(line, at)
            for seg in _segments(line, at):
                segments.append(seg)
                owner.append(i)
        base.append(found)
    added: list[list] = [[] for _ in texts]
    order = sorted(range(len(segments)), key=lambda j: len(segments[j]))
    for block in _blocks(order, segments):
        for j, labels in zip(block, model.decode([[w for w, _ in segments[j]] for j in block])):
            seg, i, t = segments[j], owner[j], 0
            while t < len(seg):
                name = LABELS[labels[t]]
                end = t + 1
                if name != "O":
                    while end < len(seg) and LABELS[labels[end]] == "I" + name[1:]:
                        end += 1
                    start, stop, text = seg[t][1], seg[end - 1][1] + len(seg[end - 1][0]), texts[i]
                    while stop > start and text[stop - 1] in _trim and not (text[stop - 1] in ")]}" and name[2:] == "email" and text[stop - 1 - 3 : stop - 1].lower() in ("dot",)):
                        stop -= 1
                    if stop > start and _plausible(name[2:], text[start:stop]):
                        added[i].append((name[2:], start, stop))
                t = end
    out = []
    for found, more in zip(base, added):
        more = [s for s in more if not any(s[1] < e and s[2] > b for _, b, e in found)]
        rank = lambda s: (KINDS.index(s[0]), s[1], s[2])
        out.append((sorted(found, key=rank), sorted(set(found + more), key=rank)))
    return out


def _text(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, text_col: str = "text", labelled: pd.DataFrame | None = None) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base spans of each kind), base_spans, spans (kind:start:end,
    code points, by kind as listed, then start, comma-joined; spans are base spans and the model's) and n_spans.

    labelled: the small table (text, spans) the model is trained from, here on the driver; its weights
    travel with the function (a few hundred kB). The model's spans that overlap a base span are dropped.
    A null or empty text has no spans; a text of any length is searched whole, in linear time and with
    bounded padding. Rows are judged one by one, so ties and repeated rows come back as they are; an
    empty table gives an empty one; input columns named like an output are replaced.
    """
    model = train_table(example_table() if labelled is None else labelled)
    rows = without(docs, OUT)
    names = rows.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"n_{k} long" for k in KINDS] + ["base_spans string", "spans string", "n_spans long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text_col))
            for at in range(0, batch.num_rows, 500):
                found = find_spans(texts.slice(at, 500).to_pylist(), model)
                counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
                both = [pa.array([_text(x[j]) for x in found], pa.string()) for j in (0, 1)]
                total = pa.array([len(x[1]) for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.slice(at, 500).columns, *counts, *both, total], [*names, *OUT])

    return rows.mapInArrow(run, schema)


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by [kind]; overlapping spans by the first one's kind."""
    out, at = [], 0
    parts = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    for a, b, kind in parts:
        if a < at:
            continue
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()

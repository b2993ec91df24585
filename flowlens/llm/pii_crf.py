"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes for what they miss.

The patterns (e-mail, IP address, card, phone) give the base spans. The field labels the words that hold a digit or an
``@``: all others can only be outside, so a text falls into short chains between them, and decoding these is the decoding
of the whole text. Features are shapes, lengths, digit counts, checks (Luhn, address parts) and the neighbours' shapes.

It is trained from a small labelled table: the lines of ``LABELLED`` and at most ``FIT_ROWS`` documents whose base
spans are the labels. Training maximises the conditional likelihood by forward and backward sums over padded batches; Viterbi
decoding runs in numpy over all chains of an Arrow batch. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import prepare

KINDS = ("email", "ip", "card", "phone")
#: Bound of the documents that join the labelled lines.
FIT_ROWS = 400
STEPS = 120

# The labelled lines: <kind>span</kind>.
LABELLED = (
    "write to <email>ann.lee@mail.example.org</email> before noon",
    "contact <email>j_doe99@sub.example.co</email>, or call <phone>+44 20 7946 0018</phone>.",
    "mail <email>info@müller.example</email> or <email>support@localhost</email> for help",
    "reach me at <email>büro@example.net</email> until 5 pm on 12 May 2021",
    "the host <ip>10.20.30.40</ip> answered 3 times in 25 ms",
    "from <ip>192.168.0.12:8080</ip> to <ip>172.16.4.1/24</ip> on port 443",
    "version 2.0.1 and 10.4 are not addresses, 1.2.3 neither, nor 300.400.500.600",
    "paid with <card>4111 1111 1111 1111</card> on 2020-05-17 for 12.50",
    "card <card>5500-0000-0000-0004</card> expires 09/27",
    "number <card>4012888888881881</card> was used, order 90817263 was not",
    "order 1234567890123456 shipped 17 items, total 4.99",
    "call <phone>(555) 010-4477</phone> or <phone>555-010-7788</phone> today",
    "phone <phone>+1 (377) 555-0271</phone> between 9 and 17",
    "ring <phone>030 555 0199 20</phone> in the morning, room 12",
    "fax <phone>0044 20 7946 0958</phone> page 3 of 14",
    "released under version 3 in 2019, see section 4.0 and page 220",
    'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" and 7 more',
    "@ 5 euros each, 2x4 boards and 3@once in the 1990s",
)

_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _address(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in text.split("."))


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: the local part is the run of its characters before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
        if at >= 0:
            free = max(free, text.rfind("@", free, at) + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``kind number, start, end`` of the patterns, in order of kind and start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _address(m[0])]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _shape(word: str) -> str:
    """Digits as 0, letters as a, repeats once; at most eight signs."""
    out = []
    for c in word[:64]:
        s = "0" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)[:8]


def _features(words: list[str], i: int, before: str, after: str) -> list[str]:
    word = words[i]
    core = word.strip(".,;:!?\"'*&%$#|[]{}")
    digits = "".join(c for c in core if "0" <= c <= "9")
    near = [words[i - 1] if i else before, words[i + 1] if i + 1 < len(words) else after]
    out = ["bias", f"shape={_shape(core)}", f"digits={min(len(digits), 20)}", f"dots={min(core.count('.'), 4)}",
           f"left={_shape(near[0])}", f"right={_shape(near[1])}", f"left,shape={_shape(near[0])},{_shape(core)}",
           f"first={core[:1] if not core[:1].isalnum() else 'x'}", f"length={min(len(core), 24) // 3}"]
    if "@" in core:
        out += ["at", f"at,dots={min(core.rpartition('@')[2].count('.'), 2)},{core[:1] == '@'},{core[-1:] == '@'}"]
    if 16 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    if core.count(".") == 3 and _shape(core).startswith("0.0.0.0"):
        out.append(f"parts={_address(re.split('[^0-9.]', core)[0])}")
    run = "".join(c for w in words[max(0, i - 3): i + 4] for c in w if "0" <= c <= "9")
    out.append(f"run={min(len(run), 24) // 2}")
    return out


def chains(text: str):
    """Runs of neighbouring words that hold a digit or ``@``: the words' borders and the plain words around them."""
    if "@" not in text and not _DIGIT.search(text):
        return
    run, before, last = [], "", ""
    for m in _WORD.finditer(text):
        word = m[0]
        if "@" in word or _DIGIT.search(word):
            if not run:
                before = last
            run.append((m.start(), m.end()))
        elif run:
            yield run, before, word
            run = []
        last = word
    if run:
        yield run, before, ""


class Crf:
    """Weights of features and of label pairs; label 0 is outside, ``1 + 2k`` begins kind ``k``, ``2 + 2k`` goes on."""

    LABELS = 1 + 2 * len(KINDS)

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.unary = np.zeros((len(names) + 1, self.LABELS))  # the last row stays 0: unknown features and padding
        self.pair = np.zeros((self.LABELS, self.LABELS))
        #: A kind goes on only after the same kind.
        self.wall = np.zeros((self.LABELS, self.LABELS))
        for k in range(len(KINDS)):
            self.wall[:, 2 + 2 * k] = -1e4
            self.wall[1 + 2 * k: 3 + 2 * k, 2 + 2 * k] = 0
        self.gate = np.array([0.0] + [0.0, -1e4] * len(KINDS))

    def encode(self, sequences: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded feature numbers (sequence, place, feature) and lengths."""
        length = max(map(len, sequences))
        width = max(len(f) for s in sequences for f in s)
        out = np.full((len(sequences), length, width), len(self.names), np.int32)
        for i, s in enumerate(sequences):
            for j, feats in enumerate(s):
                ids = [self.names[f] for f in feats if f in self.names]
                out[i, j, : len(ids)] = ids
        return out, np.array([len(s) for s in sequences])

    def viterbi(self, feats: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels (sequence, place); places beyond the length are 0."""
        n, length = feats.shape[:2]
        step = self.pair + self.wall
        score = self.unary[feats[:, 0]].sum(1) + self.gate
        back = np.zeros((n, length, self.LABELS), np.int8)
        ends = [score]
        for t in range(1, length):
            options = score[:, :, None] + step
            back[:, t] = options.argmax(1)
            score = options.max(1) + self.unary[feats[:, t]].sum(1)
            ends.append(score)
        out = np.zeros((n, length), np.int64)
        rows = np.arange(n)
        label = np.stack(ends, 1)[rows, lengths - 1].argmax(1)
        for t in range(length - 1, -1, -1):
            live = t < lengths
            out[live, t] = label[live]
            label = np.where(live & (t > 0), back[rows, t, label], label)
        return out

    def fit(self, feats: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Crf:
        """Adam on the regularised conditional log-likelihood; gradients from forward and backward sums."""
        n, length = feats.shape[:2]
        live = np.arange(length) < lengths[:, None]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.unary, self.pair)]
        real_pairs = np.zeros_like(self.pair)
        for t in range(1, length):
            np.add.at(real_pairs, (labels[live[:, t], t - 1], labels[live[:, t], t]), 1)
        for step in range(1, steps + 1):
            emit = self.unary[feats].sum(2)
            emit[:, 0] += self.gate
            move = self.pair + self.wall
            ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
            ahead[:, 0] = emit[:, 0]
            for t in range(1, length):
                ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + move, axis=1) + emit[:, t]
            for t in range(length - 2, -1, -1):
                later = np.logaddexp.reduce(move + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
                behind[:, t] = np.where(live[:, t + 1, None], later, 0)
            total = np.logaddexp.reduce(ahead[np.arange(n), lengths - 1], axis=1)
            belief = np.exp(ahead + behind - total[:, None, None]) * live[:, :, None]
            belief[live, labels[live]] -= 1
            slope = np.zeros_like(self.unary)
            np.add.at(slope, feats.reshape(-1, feats.shape[2]), belief.reshape(-1, 1, self.LABELS))
            slope[-1] = 0
            turns = -real_pairs
            for t in range(1, length):
                both = np.exp(ahead[:, t - 1, :, None] + move + (emit[:, t] + behind[:, t])[:, None, :] - total[:, None, None])
                turns = turns + (both * live[:, t, None, None]).sum(0)
            for p, g, m in ((self.unary, slope, moments[0]), (self.pair, turns, moments[1])):
                g = g + 0.05 * p
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                p -= 0.15 * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-8)
        return self


def _labelled_chains(text: str, spans: list[tuple[int, int, int]]):
    """Features and labels of the chains of a text whose true spans are known."""
    for run, before, after in chains(text):
        words = [text[a:b] for a, b in run]
        labels, last = [], None
        for a, b in run:
            hit = next(((k, s, e) for k, s, e in spans if a < e and s < b), None)
            labels.append(0 if hit is None else 2 + 2 * hit[0] if hit == last else 1 + 2 * hit[0])
            last = hit
        yield [_features(words, i, before, after) for i in range(len(words))], labels


def labelled_lines(lines=LABELLED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Plain text and spans of tagged lines."""
    out = []
    for line in lines:
        text, spans = "", []
        for part in re.split(r"(<(?:email|ip|card|phone)>.*?</\w+>)", line):
            tag = re.fullmatch(r"<(\w+)>(.*)</\w+>", part)
            if tag:
                spans.append((KINDS.index(tag[1]), len(text), len(text) + len(tag[2])))
            text += tag[2] if tag else part
        out.append((text, spans))
    return out


def fit_crf(examples: list[tuple[str, list[tuple[int, int, int]]]], longest: int = 40) -> Crf:
    """Trains on texts and their spans; chains beyond ``longest`` words (tables of numbers) are no training examples."""
    found = [c for text, spans in examples for c in _labelled_chains(text, spans) if len(c[1]) <= longest]
    names: dict[str, int] = {}
    for feats, _ in found:
        for f in (f for word in feats for f in word):
            names.setdefault(f, len(names))
    model = Crf(names)
    feats, lengths = model.encode([f for f, _ in found])
    labels = np.zeros(feats.shape[:2], np.int64)
    for i, (_, own) in enumerate(found):
        labels[i, : len(own)] = own
    return model.fit(feats, lengths, labels)


def sample_texts(docs: DataFrame, text: str, rows: int = FIT_ROWS, longest: int = 4000) -> list[str]:
    """At most ``rows`` texts with digits or ``@``, up to ``longest`` characters each, the same ones on every run."""
    fit = docs.filter(F.col(text).rlike("[0-9@]") & (F.length(text) <= longest)).select(F.col(text).alias("_t"))
    return [r["_t"] for r in fit.orderBy(F.xxhash64("_t"), "_t").limit(rows).collect()]


def fit_pii(docs: DataFrame, text: str = "text", rows: int = FIT_ROWS) -> Crf:
    prepare(docs.sparkSession)
    return fit_crf([(t, base_spans(t)) for t in sample_texts(docs, text, rows)] + labelled_lines() * 3)


def found_spans(model: Crf, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The field's spans of each text, without the signs around them."""
    where, sequences = [], []
    for number, text in enumerate(texts):
        for run, before, after in chains(text):
            words = [text[a:b] for a, b in run]
            where.append((number, run))
            sequences.append([_features(words, i, before, after) for i in range(len(words))])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(sequences):
        by_length.setdefault(len(s).bit_length(), []).append(i)
    for group in by_length.values():  # chains of like length are padded to the same width
        for low in range(0, len(group), 4096):
            part = group[low: low + 4096]
            labels = model.viterbi(*model.encode([sequences[i] for i in part]))
            for i, own in zip(part, labels, strict=True):
                number, run = where[i]
                spans: list[list[int]] = []
                for (a, b), label in zip(run, own[: len(run)].tolist(), strict=True):
                    if label and label % 2 == 0 and spans and spans[-1][2] == last_end:
                        spans[-1][2] = b
                    elif label:
                        spans.append([(label - 1) // 2, a, b])
                    last_end = b if label else -1
                for kind, a, b in spans:
                    piece = texts[number][a:b]
                    a += len(piece) - len(piece.lstrip("\"'.,;:!?*&%$#|[]{}<>"))
                    b -= len(piece) - len(piece.rstrip("\"'.,;:!?*&%$#|[]{}<>"))
                    if a < b:
                        out[number].append((kind, a, b))
    return out


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def pii_spans(model: Crf):
    """The patterns and the model as a column function of a text: counts and lists of spans (code points)."""
    def run(column: pa.Array) -> pa.Array:
        texts = [t or "" for t in column.to_pylist()]
        rows = []
        for text, more in zip(texts, found_spans(model, texts), strict=True):
            base = base_spans(text)
            added = [s for s in more if not any(s[1] < e and b < s[2] for _, b, e in base)]
            counts = [sum(k == i for k, _, _ in base) for i in range(4)]
            rows.append({**{f"n_{k}": c for k, c in zip(KINDS, counts, strict=True)},
                         "base": _listed(base), "spans": _listed(base + added), "n_added": len(added)})
        kinds = [(f"n_{k}", pa.int64()) for k in KINDS] + [("base", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
        return pa.array(rows, pa.struct(kinds))
    return F.arrow_udf(run, "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long")


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id", model: Crf | None = None) -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` per document.

    The counts and the digest are of the base spans; ``spans`` lists these and the ``n_added`` that the field adds where no
    base span is. Null and empty texts have no spans. Repeated rows repeat the result; a table without digits trains on the
    labelled lines alone.
    """
    model = model or fit_pii(docs, text)
    got = docs.select(F.col(key).alias(key), pii_spans(model)(F.col(text)).alias("_r"))
    return got.select(key, *[F.col("_r")[f"n_{k}"].alias(f"n_{k}") for k in KINDS],
                      F.sha2(F.col("_r")["base"].cast("binary"), 256).alias("base_sha256"),
                      F.col("_r")["spans"].alias("spans"), F.col("_r")["n_added"].alias("n_added"))

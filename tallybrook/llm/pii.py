"""Personal data in whole texts: exact base patterns plus a semi-Markov CRF.

The base finds e-mail addresses, IPs, cards and phones by fixed patterns.  The CRF
scores *segments* (runs of tokens) by features of the whole segment and of its
neighbours, and a forward dynamic program over segments of bounded length picks
boundaries and kinds jointly.  It is trained here by conditional likelihood on
windows of a bounded sample of documents, labelled by the base patterns, and on the same
windows with their spans written another way (spelt-out marks, other separators), so that it
finds what the base can't.  Windows are cut around digits and at-marks; text outside them is
label O.  An entity has at most 24 tokens and 24 digits.  Spans of the CRF that overlap no base span are added; base spans always stay.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.text import blocks, small_batches

# The kinds and their base patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A leftmost match never begins inside a run of digits, so only heads of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Every ip, card and phone match lies inside one of these.
_ZONE = re.compile(r"[0-9+][+ ().0-9-]{6,}")
#: What the CRF looks at: digits with other separators too, and at-marks, spelt out or not.
_WIDE = re.compile(r"[0-9+][+ ()./_\[\]0-9-]{6,}")
_AT = re.compile(r"@|[(\[{] ?at ?[)\]}]")
_DOT = re.compile(r"[(\[{] ?dot ?[)\]}]|\[\.\]")
_TOKEN = re.compile(r"@|[(\[{] ?(?:at|dot) ?[)\]}]|\[\.\]|[0-9]+|[A-Za-z]+|\s|[^\sA-Za-z0-9]")
_DIM = 1 << 12
#: Bounds of an entity, by which the dynamic program is a bounded one: tokens and digits.
_MAX_TOKENS, _MAX_DIGITS = 24, 24
_WINDOW = 24
_JOINS = frozenset("0123456789./_-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from their at-signs: the local part is the run before one."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        nxt = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            nxt = last = m.end()
        at = text.find("@", nxt)
    return found


def base_spans(text: str) -> list[Span]:
    """Base spans by kind as in KINDS, then start; code points, end exclusive."""
    ips, cards, phones = [], [], []
    for zone in _ZONE.finditer(text):
        z, o = zone.group(), zone.start()
        if z.count(".") >= 3:
            ips += [("ip", o + m.start(), o + m.end()) for m in _IP.finditer(z) if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m.group().split(".")))]
        if len(z) >= 9:
            cards += [("card", o + m.start(), o + m.end()) for m in _CARD.finditer(z) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
            if "+" in z:
                phones += [("phone", o + m.start(), o + m.end()) for m in _PHONE.finditer(z) if 9 <= len(_digits(m.group())) <= 15]
    return emails(text) + ips + cards + phones if "@" in text else ips + cards + phones


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold personal data, disjoint and in order; the rest of the text is label O."""
    spots = [(m.start(), m.end()) for m in _WIDE.finditer(text) if sum("0" <= c <= "9" for c in m.group()) >= 4]
    spots += [(m.start(), m.end()) for m in _AT.finditer(text)]
    out: list[list[int]] = []
    for a, b in sorted(spots):
        a, b = max(0, a - _WINDOW), min(len(text), b + _WINDOW)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % _DIM


def _kind_of(c: str) -> str:
    return "d" if "0" <= c <= "9" else "a" if c.isalpha() else "s" if c.isspace() else c if c in "+@.-_()[]:=/" else "p"


def _features(text: str, a: int, b: int) -> np.ndarray:
    """Features of the whole segment text[a:b] and of the characters beside it."""
    s = text[a:b]
    d = _digits(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    at, dots = _AT.search(s) is not None, len(_DOT.findall(s)) or s.count(".")
    names = [
        "bias", f"nd{min(len(d), 20)}", f"len{min(len(s) // 3, 12)}", f"at{at}", f"plus{s[0] == '+'}", f"dots{min(dots, 5)}", f"alpha{any(c.isalpha() for c in s)}",
        f"space{' ' in s}", f"luhn{13 <= len(d) <= 19 and luhn(d)}", f"groups{'-'.join(map(str, groups[:6]))}", f"ng{min(len(groups), 8)}", f"first{_kind_of(s[0])}", f"last{_kind_of(s[-1])}",
        f"left{_kind_of(text[a - 1]) if a else '^'}", f"right{_kind_of(text[b]) if b < len(text) else '$'}", f"octets{len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in re.findall('[0-9]+', s))}",
        f"tail{at and bool(re.search(r'([.]|[(\[{] ?dot ?[)\]}])[A-Za-z]{2,10}$', s))}", f"pure{bool(re.fullmatch(r'[0-9.]+', s))}", f"spelt{at and '@' not in s}",
        f"marks{''.join(sorted({c for c in s if not c.isalnum()}))[:6]}", f"even{len(groups)}{len(set(groups)) == 1}",
    ]
    return np.array([_slot(n) for n in names])


def candidates(text: str) -> tuple[list[int], Iterator[tuple[int, int, np.ndarray]]]:
    """Token bounds of a window, and its candidate segments (token from, to, features) in order of their first token.

    A candidate begins and ends at a letter, digit, '+' or '(' and holds an at-mark, or digits: six, or four with three
    dots. It has at most _MAX_TOKENS tokens and _MAX_DIGITS digits, no two spaces in a row, and isn't part of a longer
    run of characters joined by dots, slashes and the like.
    """
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]

    def found() -> Iterator[tuple[int, int, np.ndarray]]:
        for i, (a, _) in enumerate(tokens):
            if not (text[a].isalnum() or text[a] in "+(" and not _AT.match(text, a)) or a and text[a - 1] in _JOINS:
                continue
            digits = dots = 0
            at = alpha = space = False
            for j in range(i, min(len(tokens), i + _MAX_TOKENS)):
                x, y = tokens[j]
                piece = text[x:y]
                if piece.isspace():
                    if piece != " " or at or text[y : y + 1].isspace():
                        break
                    space = True
                elif _AT.fullmatch(piece):
                    if at or space:
                        break
                    at = True
                elif piece == "." or _DOT.fullmatch(piece):
                    dots += 1
                elif "0" <= piece[0] <= "9":
                    digits += y - x
                    if digits > _MAX_DIGITS and not at:
                        break
                elif piece.isalpha():
                    if space or not at and y < len(text) and text[y].isspace():
                        break
                    alpha = True
                if piece.isalnum() and not (text[y : y + 1] in _JOINS and text[y + 1 : y + 2].isalnum()) and (at if alpha or at else digits >= 6 or digits >= 4 and dots >= 3):
                    yield i, j + 1, _features(text, a, y)

    return [t[0] for t in tokens] + [len(text)], found()


def segments(text: str) -> tuple[list[int], list[tuple[int, int, np.ndarray]]]:
    """``candidates`` as a list."""
    bounds, found = candidates(text)
    return bounds, list(found)


@dataclass
class Model:
    """Weights of a segment's features by kind, and of one label after another (0 is O)."""

    emit: np.ndarray
    move: np.ndarray

    @staticmethod
    def zero() -> "Model":
        return Model(np.zeros((len(KINDS), _DIM)), np.zeros((len(KINDS) + 1, len(KINDS) + 1)))

    def scores(self, segs: list) -> np.ndarray:
        return np.array([self.emit[:, f].sum(axis=1) for _, _, f in segs]) if segs else np.zeros((0, len(KINDS)))


def _forward(n: int, segs: list, scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Log sums of all labelled segmentations up to each token, by the last label."""
    k = len(KINDS) + 1
    table = np.full((n + 1, k), -np.inf)
    table[0, 0] = 0.0
    ending: dict[int, list[int]] = {}
    for x, (_, j, _) in enumerate(segs):
        ending.setdefault(j, []).append(x)
    for j in range(1, n + 1):
        table[j, 0] = np.logaddexp.reduce(table[j - 1] + move[:, 0])
        for x in ending.get(j, ()):
            value = np.logaddexp.reduce(table[segs[x][0]][:, None] + move[:, 1:] + scores[x][None, :], axis=0)
            table[j, 1:] = np.logaddexp(table[j, 1:], value)
    return table


def decode(model: Model, bounds: list[int], segs) -> list[Span]:
    """The best labelled segmentation's entities. Segments come in order of their first token and are scored as they
    come, so memory is a few numbers a token, however long the window is."""
    n, k = len(bounds) - 1, len(KINDS) + 1
    table = np.full((n + 1, k), -np.inf)
    table[0, 0] = 0.0
    came_from, came_by = np.zeros((n + 1, k), dtype=np.int32), np.zeros((n + 1, k), dtype=np.int8)
    segs, place = iter(segs), 0
    seg = next(segs, None)
    while place < n:
        step = table[place][:, None] + model.move
        by, top = step.argmax(axis=0), step.max(axis=0)
        if top[0] > table[place + 1, 0]:
            table[place + 1, 0], came_from[place + 1, 0], came_by[place + 1, 0] = top[0], place, by[0]
        while seg is not None and seg[0] == place:
            value = top[1:] + model.emit[:, seg[2]].sum(axis=1)
            better = np.flatnonzero(value > table[seg[1], 1:])
            table[seg[1], better + 1] = value[better]
            came_from[seg[1], better + 1], came_by[seg[1], better + 1] = place, by[better + 1]
            seg = next(segs, None)
        place += 1
    j, y, out = n, int(np.argmax(table[n])), []
    while j > 0:
        if y:
            out.append((KINDS[y - 1], bounds[came_from[j, y]], bounds[j]))
        j, y = int(came_from[j, y]), int(came_by[j, y])
    return out[::-1]


def spelt(text: str, spans: list[Span], turn: int) -> tuple[str, list[Span]] | None:
    """The window with its spans written another way, which the base patterns don't match; None without spans."""
    if not spans:
        return None
    out, at, moved = [], 0, []
    marks = ((" (at) ", "."), ("(at)", "."), ("[at]", "[dot]"), ("[at]", "."), ("(at)", "(dot)"))[turn % 5]
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            return None
        s = text[a:b]
        if kind == "email":
            s = s.replace("@", marks[0].strip()).replace(".", marks[1])
        elif kind == "ip":
            s = s.replace(".", ("[.]", "(dot)", "[dot]")[turn % 3])
        elif kind == "card":
            d = _digits(s)
            s = ("/", ".", "_")[turn % 3].join(d[i : i + 4] for i in range(0, len(d), 4))
        else:
            d = _digits(s)
            s = (f"00{d[:-7]}/{d[-7:-4]}/{d[-4:]}", f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"+{d[:-7]}/{d[-7:-4]}.{d[-4:]}")[turn % 3]
        out.append(text[at:a])
        start = sum(map(len, out))
        out.append(s)
        moved.append((kind, start, start + len(s)))
        at = b
    return "".join([*out, text[at:]]), moved


def train(examples: list[tuple[str, list[Span]]], *, epochs: int = 6, rate: float = 0.3, decay: float = 1e-3) -> Model:
    """Conditional likelihood by gradient steps (Adagrad) over labelled windows; order of examples is fixed."""
    model = Model.zero()
    grown_e, grown_m = np.full_like(model.emit, 1e-2), np.full_like(model.move, 1e-2)
    ready = []
    for text, spans in examples:
        bounds, segs = segments(text)
        if not segs:
            continue
        where = {b: i for i, b in enumerate(bounds)}
        gold, at = [], {(i, j): x for x, (i, j, _) in enumerate(segs)}
        for kind, a, b in sorted(spans, key=lambda s: s[1]):
            key = (where.get(a), where.get(b))
            if key in at and (not gold or gold[-1][1] <= key[0]):
                gold.append((key[0], key[1], at[key], KINDS.index(kind)))
        ready.append((len(bounds) - 1, segs, gold))
    k = len(KINDS) + 1
    for _ in range(epochs):
        for n, segs, gold in ready:
            scores = model.scores(segs)
            fwd = _forward(n, segs, scores, model.move)
            whole = np.logaddexp.reduce(fwd[n])
            bwd = np.full((n + 1, k), -np.inf)
            bwd[n] = 0.0
            from_: dict[int, list[int]] = {}
            for x, (i, _, _) in enumerate(segs):
                from_.setdefault(i, []).append(x)
            for i in range(n - 1, -1, -1):
                bwd[i] = model.move[:, 0] + bwd[i + 1, 0]
                for x in from_.get(i, ()):
                    bwd[i] = np.logaddexp(bwd[i], np.logaddexp.reduce(model.move[:, 1:] + (scores[x] + bwd[segs[x][1], 1:])[None, :], axis=1))
            step_e, step_m = np.zeros_like(model.emit), np.zeros_like(model.move)
            for j in range(n):
                step_m[:, 0] -= np.exp(fwd[j] + model.move[:, 0] + bwd[j + 1, 0] - whole)
            for x, (i, j, f) in enumerate(segs):
                p = np.exp(fwd[i][:, None] + model.move[:, 1:] + (scores[x] + bwd[j, 1:])[None, :] - whole)
                step_m[:, 1:] -= p
                step_e[:, f] -= p.sum(axis=0)[:, None]
            pos, last = 0, 0
            for i, j, x, y in gold:
                if i > pos:
                    step_m[last, 0] += 1
                    step_m[0, 0] += i - pos - 1
                    last = 0
                step_m[last, y + 1] += 1
                step_e[y, segs[x][2]] += 1
                pos, last = j, y + 1
            if n > pos:
                step_m[last, 0] += 1
                step_m[0, 0] += n - pos - 1
            touched = step_e != 0
            grown_e[touched] += step_e[touched] ** 2
            grown_m += step_m**2
            model.emit[touched] += rate * (step_e[touched] / np.sqrt(grown_e[touched])) - decay * model.emit[touched]
            model.move += rate * step_m / np.sqrt(grown_m)
    return model


def find(text: str, model: Model | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and spans that the CRF adds."""
    base, extra = base_spans(text), []
    if model is not None:
        taken = sorted((a, b) for _, a, b in base)
        for a, b in windows(text):
            piece = text[a:b]
            for kind, x, y in decode(model, *candidates(piece)):
                near = bisect.bisect_left(taken, (a + x, 0))
                if not any(p < a + y and a + x < q for p, q in taken[max(0, near - len(KINDS)) : near + len(KINDS)]):
                    extra.append((kind, a + x, a + y))
    return base, extra


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 4000, sample_windows: int = 400) -> Model:
    """Fit the CRF on windows of at most ``sample_docs`` documents (those of smallest id hash)
    and at most ``sample_windows`` windows of at most 400 characters; both are documented bounds.
    An empty sample gives zero weights, which add nothing.
    """
    small_batches(docs.sparkSession)
    key = F.xxhash64(docs[id_col].cast("string"))
    last = docs.filter(docs[id_col].isNotNull()).select(key.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    if last is None:
        return Model.zero()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            got = []
            for h, text in zip(block.column("h").to_pylist(), block.column("text").to_pylist(), strict=True):
                if text:
                    base = base_spans(text)
                    for a, b in windows(text):
                        if b - a <= 400:
                            got.append((h, a, text[a:b], ",".join(f"{k}:{x - a}:{y - a}" for k, x, y in base if a <= x and y <= b)))
            if got:
                h, a, t, s = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(a, pa.int64()), pa.array(t, pa.string()), pa.array(s, pa.string())], names=["h", "a", "window", "spans"])

    rows = docs.filter(key <= last).select(key.alias("h"), docs[text_col].alias("text")).mapInArrow(task, "h long, a long, window string, spans string")
    got = rows.orderBy((F.col("spans") == "").cast("int"), "h", "a", "window").limit(sample_windows).collect()
    rest = rows.filter("spans = ''").orderBy("h", "a", "window").limit(sample_windows // 2).collect()
    picked = {(r.h, r.a, r.window): r for r in [*got, *rest]}
    parse = lambda s: [(k, int(a), int(b)) for k, a, b in (p.split(":") for p in s.split(","))] if s else []
    examples = [(r.window, parse(r.spans)) for _, r in sorted(picked.items())]
    # each window of personal data once more, its spans written as the base doesn't know them
    return train(examples + [x for turn, (t, spans) in enumerate(examples) if (x := spelt(t, spans, turn))])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_pii(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", mask: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Per row: id, base (kind:start:end by kind, then start), added (spans of the CRF), and with ``mask``
    also masked: the text with each span replaced by its kind in brackets.

    A null text is treated as empty (masked stays null).  Rows are kept as they are, repeated ones too;
    of other columns those in ``keep`` are carried.  Spans count code points, end exclusive.
    """
    carried = [c for c in (keep or []) if c != id_col]
    small_batches(docs.sparkSession)
    send = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: _DIM weights a kind

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = send.value
        for block in blocks(batches, "__text"):
            base, added, masked = [], [], []
            for text in block.column("__text").to_pylist():
                b, e = find(text, crf) if text else ([], [])
                base.append(_joined(b))
                added.append(_joined(e))
                if mask:
                    masked.append(masked_text(text, b + e))
            yield pa.RecordBatch.from_arrays([block.column(0), *(block.column(c) for c in carried), pa.array(base, pa.string()), pa.array(added, pa.string()), *([pa.array(masked, pa.string())] if mask else [])], names=[id_col, *carried, "base", "added", *(["masked"] if mask else [])])

    rows = docs.select(docs[id_col], *(docs[c] for c in carried), docs[text_col].alias("__text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(task, ", ".join(f"`{c}` {kinds[c]}" for c in [id_col, *carried]) + ", base string, added string" + ", masked string" * mask)


def masked_text(text: str | None, spans: list[Span]) -> str | None:
    """The text with spans replaced by [EMAIL] and so on; overlapping spans are one, named by the first."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()

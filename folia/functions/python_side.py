"""Functions no built-in expression can give, as plain Python; operators lift them into Arrow UDFs.

Cover density and word similarity are the measures of the published definitions: minimal covers over
positions with the usual weight, and trigram similarity over extents of ordered trigrams.
"""

from __future__ import annotations

import json
import re
import unicodedata
from fractions import Fraction
from functools import lru_cache
from math import ceil, floor, log, sqrt

from .runs import first_occurrences

_TOKEN = re.compile(r"[^\W_]+")


class _Marks(dict):
    """For str.translate: marks go; a character is looked up once."""

    def __missing__(self, code: int) -> int | None:
        self[code] = None if unicodedata.category(chr(code)) == "Mn" else code
        return self[code]


_MARKS = _Marks()


def fold(s: str) -> str:
    if s.isascii():
        return s.lower()
    return unicodedata.normalize("NFD", s.replace("đ", "d").replace("Đ", "D")).translate(_MARKS).lower()


def tokens(s: str) -> list[str]:
    return _TOKEN.findall(fold(s))


WEIGHT = 0.1  # fixed value: the usual weight of a position


def minimal_covers(entries: list[tuple[int, str]], alternatives: list[list[str]]) -> list[tuple[int, int]]:
    """First and last entry of every shortest extent that holds all terms of an alternative, by start.
    entries: position and term, in order."""
    last: dict[str, int] = {}
    out, begun = [], -1
    for k, (_, term) in enumerate(entries):
        last[term] = k
        start = max((min(last[t] for t in a) for a in alternatives if all(t in last for t in a)), default=-1)
        if start > begun:
            out.append((start, k))
            begun = start
    return out


def cover_density(entries: list[tuple[int, str]], alternatives: list[list[str]]) -> float:
    """The sum over minimal covers of the mean weight of their entries by 1 + the words between them that are none."""
    rank = 0.0
    for a, z in minimal_covers(entries, alternatives):
        rank += WEIGHT / (1 + entries[z][0] - entries[a][0] - (z - a))
    return rank


def entries_of(words: list[str], alternatives: list[list[str]]) -> list[tuple[int, str]]:
    wanted = {t for a in alternatives for t in a}
    return [(i, w) for i, w in enumerate(words) if w in wanted]


def ordered_trigrams(s: str) -> list[str]:
    return [f"  {w} "[i : i + 3] for w in tokens(s) for i in range(len(w) + 1)]


def trigrams(s: str) -> set[str]:
    return set(ordered_trigrams(s))


def word_similarity(needle: str, text: str) -> float:
    """The greatest similarity (shared by all) of the needle's trigrams and those of any extent of the text's
    ordered trigrams; the best extent begins and ends with a shared one."""
    want, grams = trigrams(needle), ordered_trigrams(text)
    shared = [g in want for g in grams]
    most, best = len(want & set(grams)), 0.0
    if not most:
        return best
    for start, after in first_occurrences(grams):
        if not shared[start]:
            continue
        met = other = 0
        at = start
        while at < len(grams) and met < most and most > best * (len(want) + other):
            if shared[at]:
                met += 1
                best = max(best, met / (len(want) + other))
            else:
                other += 1
            at = after[at]
    return best


FAR = 512  # trigrams


def _codes(s: str):
    """A number for each place of a text of words that are set apart by three blanks, and which places begin a trigram."""
    import numpy as np

    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:], (c[1:-1] != 32) | (c[2:] != 32)


def maybe_similar(needle: str, texts: list[str], least: float):
    """False only for texts whose word similarity to the needle is below `least` (over 0), for all texts at once.

    An extent that is similar enough holds few distinct trigrams other than the needle's. A trigram not met in the FAR
    places before is new to every extent of up to FAR that it lies in, so counts of such bound the extents from each
    start; the needle's trigrams between are then counted. Trigrams that share a hash only loosen the bound."""
    import numpy as np

    want = sorted(trigrams(needle))
    fewest, others = ceil(least * len(want) - 1e-9), floor(len(want) / least - len(want) + 1e-9)
    parts = [f"  {'   '.join(ws)} " if ws else "" for ws in map(tokens, texts)]
    out = np.zeros(len(texts), bool)
    if not want or not any(parts):
        return out
    codes, begins = _codes("".join(parts))
    g = codes[begins]
    # after each text: the number of trigrams up to there
    text_ends = np.concatenate(([0], np.cumsum(begins), [len(g)] * 2))[np.cumsum([len(x) for x in parts])]
    kind = np.full(len(g), -1, np.int8 if len(want) < 128 else np.int32)
    short = (g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16)
    wanted = np.array([int(_codes(t)[0][0]) for t in want], np.uint64)
    maybe = np.zeros(1 << 16, bool)
    maybe[(wanted * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16)] = True
    near = np.flatnonzero(maybe[short])
    by = np.argsort(wanted)
    found = by[np.searchsorted(wanted, g[near], sorter=by).clip(max=len(want) - 1)]
    met = wanted[found] == g[near]
    at = near[met]
    kind[at] = found[met]
    if not len(at):
        return out
    order = np.argsort(short, kind="stable")
    same = np.flatnonzero(short[order[1:]] == short[order[:-1]])
    new = kind < 0
    new[order[same + 1]] &= order[same + 1] - order[same] > FAR
    passed = np.concatenate(([0], np.cumsum(new)))
    text = np.searchsorted(text_ends, at, side="right")
    end = np.searchsorted(passed, passed[at] + others, side="right") - 1
    long = (end - at >= FAR) & (text_ends[text] - at >= FAR)
    out[text[long]] = True
    till = np.searchsorted(at, np.minimum(end, text_ends[text]))
    some = np.flatnonzero((till - np.arange(len(at)) >= fewest) & ~long)
    for part in np.array_split(some, len(some) // 20_000 + 1):
        if len(part):
            low, high = part[0], till[part].max()
            held = np.zeros((high - low + 1, len(want)), np.int32)
            held[np.arange(1, high - low + 1), kind[at[low:high]]] = 1
            held = held.cumsum(0, dtype=np.int32)
            distinct = ((held[till[part] - low] - held[part - low]) > 0).sum(1)
            out[text[part[distinct >= fewest]]] = True
    return out


def word_similarities(needle: str, texts: list[str], least: float = 0.0) -> list[float]:
    """Word similarity of each text; where it is below `least`, that or 0. Texts are taken in slices of a million characters."""
    if least <= 0:
        return [word_similarity(needle, t) for t in texts]
    out: list[float] = []
    begin = size = 0
    for k, t in enumerate(texts, 1):
        size += len(t)
        if size >= 1_000_000 or k == len(texts):
            part = texts[begin:k]
            out += [word_similarity(needle, x) if near else 0.0 for x, near in zip(part, maybe_similar(needle, part, least), strict=True)]
            begin, size = k, 0
    return out


def headline(text: str, alternatives: list[list[str]], fragments: int = 2, most: int = 30, least: int = 10) -> str:
    """The best extents of a text, `most` words each, their matches between <mark> tags; the first `least` words
    where nothing matches. Better covers hold more matches, then fewer words; fragments never overlap."""
    parts = re.findall(r"\S+", text)
    wanted = {t for a in alternatives for t in a}
    keys = [[w for w in tokens(p) if w in wanted] for p in parts]
    entries = [(i, w) for i, ws in enumerate(keys) for w in ws]
    if not entries:
        return " ".join(parts[:least])
    covers = minimal_covers(entries, alternatives) or [(k, k) for k in range(len(entries))]
    taken: list[tuple[int, int]] = []
    for a, z in sorted(covers, key=lambda c: (-min(c[1] - c[0] + 1, most), entries[c[1]][0] - entries[c[0]][0], c)):
        first, last = entries[a][0], min(entries[z][0], entries[a][0] + most - 1)
        if len(taken) < fragments and all(last < x or y < first for x, y in taken):
            room = most - (last - first + 1)
            left = max([y + 1 for x, y in taken if y < first], default=0)
            right = min([x - 1 for x, y in taken if x > last], default=len(parts) - 1)
            first = max(left, first - room // 2)
            taken.append((first, min(right, max(last, first + most - 1))))
    said = [" ".join(f"<mark>{parts[i]}</mark>" if keys[i] else parts[i] for i in range(a, z + 1)) for a, z in sorted(taken)]
    return " ... ".join(said)


# -- exact calculator ------------------------------------------------------------------------

FUNCTIONS = ("abs", "round", "floor", "ceil", "min", "max", "sum", "avg")
MOST_CHARS, MOST_POWER = 2_000, 1_000
MOST_EXPONENT, PLACES = 1_000, 10
_CALC = re.compile(r"\s*(?:((?:\d[\d_]*(?:\.[\d_]*)*|\.\d[\d_]*)(?:e[+-]?\d+)?)|([a-z]+)|(.))", re.S)


class CalcError(ValueError):
    pass


def calculate(expression: str) -> Fraction:
    """+ - * / % ^ and parentheses over exact rationals; ^ is right-associative and above unary minus."""
    if not expression.strip():
        raise CalcError("empty expression")
    if len(expression) > MOST_CHARS:
        raise CalcError("expression too long")
    items = [m.groups() for m in _CALC.finditer(expression.strip().lower()) if m[0].strip()]
    at = 0

    def take(*signs: str) -> str | None:
        nonlocal at
        if at < len(items) and items[at][2] in signs:
            at += 1
            return items[at - 1][2]
        return None

    def total() -> Fraction:
        x = product()
        while s := take("+", "-"):
            x = x + product() if s == "+" else x - product()
        return x

    def product() -> Fraction:
        x = signed()
        while s := take("*", "/", "%"):
            y = signed()
            if s != "*" and y == 0:
                raise CalcError("division by zero")
            x = x * y if s == "*" else x / y if s == "/" else x - y * int(x / y)
        return x

    def signed() -> Fraction:
        if take("-"):
            return -signed()
        if take("+"):
            return signed()
        return power()

    def power() -> Fraction:
        x = atom()
        if take("^"):
            y = signed()
            if y.denominator != 1:
                raise CalcError("only whole powers are exact")
            if abs(y) > MOST_POWER:
                raise CalcError("power too large")
            if x == 0 and y < 0:
                raise CalcError("division by zero")
            return x ** int(y)
        return x

    def atom() -> Fraction:
        nonlocal at
        if at == len(items):
            raise CalcError("expression ends too early")
        number, name, sign = items[at]
        at += 1
        if number:
            if at < len(items) and items[at][0]:
                raise CalcError("two numbers in a row")
            digits, _, power_of_ten = number.replace("_", "").partition("e")
            if digits.count(".") > 1:
                raise CalcError("write numbers without thousands marks")
            if abs(int(power_of_ten or 0)) > MOST_EXPONENT:
                raise CalcError("exponent too large")
            return Fraction(digits + "0" if digits.endswith(".") else digits) * Fraction(10) ** int(power_of_ten or 0)
        if name:
            if name not in FUNCTIONS:
                raise CalcError(f"no function {name}")
            if not take("("):
                raise CalcError(f"{name} needs parentheses")
            args = [total()]
            while take(","):
                args.append(total())
            if not take(")"):
                raise CalcError("')' is missing")
            return apply(name, args)
        if sign == "(":
            x = total()
            if not take(")"):
                raise CalcError("')' is missing")
            return x
        raise CalcError(f"unexpected {sign!r}")

    def apply(name: str, args: list[Fraction]) -> Fraction:
        if name == "round":
            if len(args) > 2 or (len(args) == 2 and args[1].denominator != 1):
                raise CalcError("round takes a number and whole digits")
            return round_half_away(args[0], int(args[1]) if len(args) == 2 else 0)
        if name in ("abs", "floor", "ceil"):
            if len(args) != 1:
                raise CalcError(f"{name} takes one number")
            return {"abs": abs, "floor": lambda x: Fraction(floor(x)), "ceil": lambda x: Fraction(ceil(x))}[name](args[0])
        return {"min": min, "max": max, "sum": lambda a: sum(a, Fraction(0)), "avg": lambda a: sum(a, Fraction(0)) / len(a)}[name](args)

    out = total()
    if at != len(items):
        raise CalcError(f"unexpected {next(x for x in items[at] if x)!r}")
    return out


def round_half_away(x: Fraction, digits: int = 0) -> Fraction:
    scale = Fraction(10) ** digits
    y = abs(x) * scale
    return Fraction(floor(y + Fraction(1, 2)), 1) / scale * (1 if x >= 0 else -1)


def ends(x: Fraction) -> bool:
    """Whether the value has a finite decimal form, so that render gives it exactly."""
    d = x.denominator
    for p in (2, 5):
        while d % p == 0:
            d //= p
    return d == 1


def render(x: Fraction, precision: int = PLACES) -> str:
    """The exact decimal when it ends, else rounded half away from zero to `precision` places."""
    places = precision
    if ends(x):
        places, d = 0, x.denominator
        while 10**places % d:
            places += 1
    y = round_half_away(x, places)
    text = str(int(abs(y) * Fraction(10) ** places)).rjust(places + 1, "0")
    body = text if places == 0 else f"{text[:-places]}.{text[-places:]}"
    if not ends(x):
        body = body.rstrip("0").rstrip(".")
    return ("-" if y < 0 else "") + body


# -- JSON ------------------------------------------------------------------------------------


def json_problem(s: str) -> tuple[int, int, str] | None:
    """Line, column and reason of the first fault; None for valid JSON."""
    try:
        json.loads(s, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
        return None
    except json.JSONDecodeError as e:
        return e.lineno, e.colno, e.msg
    except ValueError as e:
        return 1, max(1, s.find(str(e)) + 1), f"{e} is not JSON"


def first_json(reply: str) -> str | None:
    """The first balanced JSON object or array of a reply, thinking and code fences aside."""
    s = re.sub(r"(?s)<think>.*?</think>", "", reply)
    decode = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", s):
        try:
            _, end = decode.raw_decode(s, m.start())
            return s[m.start() : end]
        except json.JSONDecodeError:
            continue
    return None


_VALUE = re.compile(r'("(?:[^"\\]|\\.)*")|(?<=[:,\[])(\s*)([-+(]?[\d(][\d\s.+\-*/%^()]*[\d)])(\s*)(?=[,}\]]|\Z)')


def repair_json(s: str) -> str:
    """Arithmetic in value positions becomes its result; strings and plain numbers stay."""

    def swap(m: re.Match) -> str:
        if m[1]:
            return m[1]
        if re.fullmatch(r"-?\d+(?:\.\d+)?", m[3].strip()):
            return m[0]
        try:
            return m[2] + render(calculate(m[3])) + m[4]
        except CalcError:
            return m[0]

    return _VALUE.sub(swap, s)


# -- hashing and alignment -------------------------------------------------------------------


def fnv1a(data: bytes, bits: int = 64) -> int:
    """The FNV-1a hash of 32 or 64 bits."""
    h, prime = (0xCBF29CE484222325, 0x100000001B3) if bits == 64 else (0x811C9DC5, 0x01000193)
    for b in data:
        h = (h ^ b) * prime % (1 << bits)
    return h


def hash_embedding(text: str, width: int = 256) -> list[float]:
    """Signed feature hashing of lower-case tokens of two bytes or more: each gives itself and a signature of its byte
    trigrams (itself up to three bytes), weighted 1 + ln(count); the top bit of a hash makes it negative. Unit length."""
    counts: dict[bytes, int] = {}
    for w in _TOKEN.findall(text.lower()):
        t = w.encode()
        if len(t) > 1:
            counts[t] = counts.get(t, 0) + 1
    v = [0.0] * width
    for t, n in counts.items():
        grams = b"".join(t[i : i + 3] for i in range(len(t) - 2))
        signature = t if len(t) <= 3 else fnv1a(grams, 32).to_bytes(4, "big")
        for feature in (t, b"3g:" + signature):
            h = fnv1a(feature)
            v[h % width] += (1 + log(n)) * (-1 if h >> 63 else 1)
    norm = sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else v


def edits(a: str, others: list[str]):
    """Edit distances of a to each of the other texts, one row of the table at a time for all of them."""
    import numpy as np

    wide = np.array([len(o) for o in others], np.int64)
    longest = int(wide.max(initial=0))
    chars = np.zeros((len(others), longest), np.int64)
    for i, o in enumerate(others):
        chars[i, : len(o)] = [ord(c) for c in o]
    steps = np.arange(longest + 1)
    last = np.tile(steps, (len(others), 1))
    for i, c in enumerate(a, 1):
        row = np.empty_like(last)
        row[:, 0] = i
        row[:, 1:] = np.minimum(last[:, 1:] + 1, last[:, :-1] + (chars != ord(c)))
        last = np.minimum.accumulate(row - steps, axis=1) + steps
    return last[np.arange(len(others)), wide]


def alike(a: str, b: str) -> float:
    """1 - edits / longer length."""
    short, long = sorted((a, b), key=len)
    return 1.0 if a == b else 1 - int(edits(short, [long])[0]) / len(long)


def words_at(s: str) -> list[tuple[int, int, str]]:
    """Start, end and key of each word between white space; a key is folded, without punctuation around it."""
    out = []
    for m in re.finditer(r"\S+", s):
        key = re.sub(r"^[\W_]+|[\W_]+$", "", fold(m[0]))
        out.append((m.start(), m.end(), key or m[0]))
    return out


def word_costs(a: list[str], b: list[str]):
    """Matrix of what it costs to pair words: 0 for the same, 1 - likeness from a half on, else 1.

    Shared characters bound the likeness from above, so few pairs are compared in full."""
    import numpy as np

    chars = {c: i for i, c in enumerate({c for w in [*a, *b] for c in w})}

    def counts(words: list[str]):
        n = np.zeros((len(words), len(chars) or 1), np.int16)
        for i, w in enumerate(words):
            for c in w:
                n[i, chars[c]] += 1
        return n

    of_a, of_b, wide = counts(a), counts(b), np.array([len(w) for w in b])
    cost = (np.array(a, object)[:, None] != np.array(b, object)[None, :]).astype(float)
    for i, w in enumerate(a):
        common = np.minimum(of_a[i], of_b).sum(1)
        near = np.flatnonzero((2 * common >= np.maximum(wide, len(w))) & (common > 0))
        if len(near):
            far = edits(w, [b[j] for j in near]) / np.maximum(wide[near], len(w))
            cost[i, near] = np.where(far <= 0.5, far, 1.0)
    return cost


@lru_cache(maxsize=1 << 18)
def word_cost(a: str, b: str) -> float:
    """One entry of word_costs."""
    if a == b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    common = sum(min(a.count(c), b.count(c)) for c in set(a))
    if not common or 2 * common < len(b):
        return 1.0
    last = list(range(len(a) + 1))
    for i, c in enumerate(b, 1):
        row = [i]
        for j, x in enumerate(a):
            row.append(min(last[j] + (x != c), last[j + 1] + 1, row[j] + 1))
        last = row
    far = last[-1] / len(b)
    return far if far <= 0.5 else 1.0


def near_align(a: list[str], b: list[str], gap: float, around: float) -> list[tuple[int, int, float]] | None:
    """align, over the diagonals that an alignment can touch whose cost is at most that of the difference of lengths and
    `around` more; None where the least cost is higher, so that what was left out may matter."""
    n, m = len(a), len(b)
    most = abs(n - m) * gap + around
    by = int(around / gap / 2 + 1e-6) + 1
    low, high = min(0, m - n) - by, max(0, m - n) + by
    far = float("inf")
    width = high - low + 3  # a column at either side stays far
    rows = [[j * gap if 0 <= (j := k - 1 + low) <= m and 0 < k < width - 1 else far for k in range(width)]]
    for i in range(1, n + 1):
        last, row, w = rows[-1], [far] * width, a[i - 1]
        for k in range(max(1, 1 - low - i), min(width - 1, m - low - i + 2)):
            j = k - 1 + low + i
            best = last[k + 1] + gap
            if row[k - 1] + gap < best:
                best = row[k - 1] + gap
            # the words are compared only where a pair at no cost would be better
            if j and last[k] < best:
                best = min(best, last[k] + word_cost(w, b[j - 1]))
            row[k] = best
        rows.append(row)
    if not rows[n][m - n - low + 1] <= most:
        return None
    out, i, j = [], n, m
    while i and j:
        k, row, last = j - i - low + 1, rows[i], rows[i - 1]
        c = word_cost(a[i - 1], b[j - 1])
        if abs(row[k] - (last[k] + c)) < 1e-9:
            out.append((i - 1, j - 1, c))
            i, j = i - 1, j - 1
        elif abs(row[k] - (last[k + 1] + gap)) < 1e-9:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align(a: list[str], b: list[str], gap: float = 0.7, most: int = 4_000_000) -> list[tuple[int, int, float]] | None:
    """Pairs with their cost in a least-cost monotone alignment of words; None when the table would exceed `most` cells."""
    import numpy as np

    n, m = len(a), len(b)
    if n * m > most:
        return None
    if not n or not m:
        return []
    around = 2.0
    while (abs(n - m) + 2 * around / gap) * 16 < m:
        if (out := near_align(a, b, gap, around)) is not None:
            return out
        around *= 4
    ka, kb = list(dict.fromkeys(a)), list(dict.fromkeys(b))
    at_a, at_b = {w: i for i, w in enumerate(ka)}, {w: i for i, w in enumerate(kb)}
    pairing, y = word_costs(ka, kb), np.array([at_b[w] for w in b])
    cost = np.zeros((n + 1, m + 1))
    cost[0] = steps = np.arange(m + 1) * gap
    for i in range(1, n + 1):
        best = np.concatenate(([i * gap], np.minimum(cost[i - 1, :-1] + pairing[at_a[a[i - 1]]][y], cost[i - 1, 1:] + gap)))
        cost[i] = np.minimum.accumulate(best - steps) + steps
    out, i, j = [], n, m
    while i and j:
        c = float(pairing[at_a[a[i - 1]], y[j - 1]])
        if abs(cost[i, j] - (cost[i - 1, j - 1] + c)) < 1e-9:
            out.append((i - 1, j - 1, c))
            i, j = i - 1, j - 1
        elif abs(cost[i, j] - (cost[i - 1, j] + gap)) < 1e-9:
            i -= 1
        else:
            j -= 1
    return out[::-1]

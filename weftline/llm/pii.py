"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss."""

from __future__ import annotations

import functools
import itertools
import random
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: Kinds in the order that spans are listed in; `key` (passwords, access keys) is the field's own.
KINDS = ("email", "ip", "card", "phone", "key")
BASE = KINDS[:4]
#: Tokens of the longest entity.
LONGEST = 24
#: Tokens beside an anchor that segments with it, and the features of those, may reach: an entity, and a hint five tokens before it.
CONTEXT = LONGEST + 8
#: No number, address or date is longer: 15 digits, and a sign in each other token.
LONGEST_NUMBER = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the pattern finds, at each @ in turn: the letters before it from the last match on, and the domain after it."""
    end = 0
    at = text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                end = m.end()
                yield start, end
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Of each longest run of numbers with dots, four at a time."""
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[k : k + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                yield at, end
            at = end + 1


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns, by kind as listed and start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += (("email", *s) for s in _emails(text))
    if _DIGIT(text):
        out += (("ip", *s) for s in _ips(text))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += (("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15)
    return out


_DIGIT = re.compile(r"[0-9]").search
_NUMBER_OR_AT = re.compile(r"[0-9@]+")
_SPELT = re.compile(r"[(\[]at[)\]]| at (?=[A-Za-z0-9-]+ dot [A-Za-z0-9])")
_TOKENS = re.compile(r"\w+|\s|[^\w\s]")
_HINT_WORDS = ("pass", "password", "passwd", "passphrase", "pwd", "token", "secret", "api", "key", "credential", "auth")
_HINTS = re.compile(rf"(?i)(?<!\w)(?:{'|'.join(_HINT_WORDS)})(?!\w)")
_EMAIL_SHAPE = re.compile(
    r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+"
    r"|[A-Za-z0-9._%+-]+(?: dot [A-Za-z0-9_%+-]+)* at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+"
).fullmatch
_IP_SHAPE = re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}").fullmatch
_NUMBERS = re.compile(r"[0-9](?:[ .-]?[0-9])*").fullmatch
_ABROAD = re.compile(r"(?:\+|00)[0-9][ ().0-9-]+[0-9]").fullmatch
_NATIONAL = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|\([0-9]{3}\)[0-9]{3}[ .-]?[0-9]{4}").fullmatch
_DATE = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}").fullmatch

_SHAPES = 7  # of the features below, those that look at the span's characters
FEATURES = (
    "email shape", "address shape", "card that passes", "card that fails", "phone abroad", "phone at home", "date shape", "key shape", "named secret",
    "bias", "one @", "9 to 15 digits", "fewer digits", "more digits", "no digit", "white space at an edge", "goes on to the left", "goes on to the right", "hint before", "= : or quote before", "line end inside", "more tokens", "white space inside", "letters and digits", "punctuation at an edge", "half a bracket",
)


#: An entity has one of the first three features, or lacks the last.
_HAS = [FEATURES.index(x) for x in ("email shape", "one @", "hint before", "no digit")]
_HAS_SIGN = np.array([1.0, 1.0, 1.0, -1.0])


def _shape(x: str, digits: int) -> tuple[int, ...]:
    d = _digits(x) if digits >= 9 else ""
    numbers = 13 <= len(d) <= 19 and _NUMBERS(x) is not None
    passes = numbers and luhn(d)
    return (
        ("@" in x or "at" in x) and _EMAIL_SHAPE(x) is not None,
        bool(digits) and _IP_SHAPE(x) is not None and all(int(p) <= 255 for p in x.split(".")),
        passes,
        numbers and not passes,
        9 <= len(d) <= 15 and _ABROAD(x) is not None,
        len(d) == 10 and _NATIONAL(x) is not None,
        bool(digits) and _DATE(x) is not None,
    )


class Lattice:
    """The tokens of a stretch of text and the features of its segments."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in _TOKENS.finditer(text)]
        n = len(self.spans)
        words = [text[a:b] for a, b in self.spans]
        add = lambda values: np.concatenate([[0], np.cumsum(np.array(values, np.int64))])
        self.digits = add([len(_digits(w)) for w in words])
        self.letters = add([sum(c.isalpha() for c in w) for w in words])
        self.ats = add([w == "@" for w in words])
        self.spelt = add([w == "at" for w in words])
        self.white = add([w.isspace() for w in words])
        self.lines = add([w == "\n" for w in words])
        self.no_key = add([not (w.isascii() and (w == "-" or w.replace("_", "a").isalnum())) for w in words])
        self.ends = np.array([0, *(b for _, b in self.spans)])
        self.space = np.array([w.isspace() for w in words] + [True])
        self.mark = np.array([not (w[0].isalnum() or w[0] in "_+(") for w in words] + [True])
        self.end_mark = np.array([not (w[-1].isalnum() or w[-1] == "_") for w in words] + [True])
        self.open = add([(w == "(") - (w == ")") for w in words])
        # a word right beside, or one past a dot (spelt or not) or hyphen, is part of the same thing
        word = [w[0].isalnum() or w[0] in "_@" for w in words]
        joined = [w in ".-_@+" for w in words]
        spelt = [w == " " and words[i - 1 : i] == ["dot"] for i, w in enumerate(words)]
        self.left = np.array([False] + [word[i] or joined[i] and i > 0 and word[i - 1] or spelt[i] for i in range(n)])
        self.right = np.array([word[i] or joined[i] and i + 1 < n and word[i + 1] or words[i : i + 2] == [" ", "dot"] for i in range(n)] + [False])
        hints = [w.lower() in _HINT_WORDS for w in words]
        self.hint = np.array([any(hints[max(0, i - 5) : i]) for i in range(n + 1)])
        self.sign = np.array([False] + [w in "=:\"'" or w == " " and i > 0 and words[i - 1] in "=:" for i, w in enumerate(words)])
        self.n = n

    def features(self, first: int, last: int) -> np.ndarray:
        """[start, tokens - 1, feature] for starts from first to last."""
        i = np.arange(first, last)[:, None]
        j = i + np.arange(1, LONGEST + 1)
        ok = j <= self.n
        j = np.minimum(j, self.n)
        digits, letters = self.digits[j] - self.digits[i], self.letters[j] - self.letters[i]
        white, ats = self.white[j] - self.white[i], self.ats[j] - self.ats[i]
        edge = self.space[i] | self.space[j - 1]
        out = np.zeros((*j.shape, len(FEATURES)))
        single = j - i > 1
        length = self.ends[j] - self.ends[i]
        solid = (self.no_key[j] == self.no_key[i]) & ~self.left[i] & ~self.right[j]
        key = (self.no_key[j] == self.no_key[i]) & (length >= 16) & (digits >= 3) & (length - digits >= 3)
        named = solid & self.hint[i] & self.sign[i] & ((length >= 12) | (digits > 0) & (length >= 6))
        for k, x in enumerate((
            key, named, np.ones_like(ok), ats == 1, (digits >= 9) & (digits <= 15), digits < 9, digits > 15, digits == 0, edge, self.left[i] & ok, self.right[j], self.hint[i] & ok, self.sign[i] & ok,
            self.lines[j] > self.lines[i], single, white > 0, (digits > 2) & (letters > 2), self.mark[i] | self.end_mark[j - 1], self.open[j] != self.open[i],
        )):
            out[..., _SHAPES + k] = x
        # what characters say is asked only of segments that it can be true of: numbers without letters, and one at sign, however long
        for a, b in np.argwhere(ok & ~edge & ((digits >= 3) & (letters == 0) & (length <= LONGEST_NUMBER) | (ats == 1) | (self.spelt[j] - self.spelt[i] == 1))).tolist():
            out[a, b, :_SHAPES] = _shape(self.text[self.spans[first + a][0] : self.spans[first + a + b][1]], int(digits[a, b]))
        out[~ok] = 0
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights of a label's features, and of labels that follow each other. Label 0 is a single token that is no entity."""

    def __init__(self) -> None:
        self.weights = np.zeros((len(FEATURES), len(KINDS) + 1))
        self.follow = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def scores(self, features: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """[start, tokens - 1, label]; impossible ones are -inf: no entity is without a digit, one at sign (spelt or not) and a hint before it."""
        out = features @ self.weights
        may = features[..., _HAS] @ _HAS_SIGN > -1
        out[..., 1:] = np.where(may[..., None], out[..., 1:], -np.inf)
        out[:, 1:, 0] = -np.inf
        out[:, 0, 0] = 0
        out[starts[:, None] + np.arange(1, LONGEST + 1) > n] = -np.inf
        return out

    def best(self, text: str) -> list[tuple[str, int, int]]:
        """The entities of the best segmentation, by dynamic programming over starts and labels."""
        lattice = Lattice(text)
        n, labels = lattice.n, len(KINDS) + 1
        value = np.full((n + LONGEST + 1, labels), -np.inf)
        came = np.zeros((n + LONGEST + 1, labels, 2), np.int32)  # tokens of the segment that ends here, label before
        value[0, 0] = 0
        for first in range(0, n, 1024):
            last = min(n, first + 1024)
            scores = self.scores(lattice.features(first, last), np.arange(first, last), n)
            for i in range(first, last):
                into = value[i][:, None] + self.follow
                before = into.argmax(axis=0)
                new = into[before, np.arange(labels)] + scores[i - first]
                place = value[i + 1 : i + 1 + LONGEST]
                better = new > place
                place[better] = new[better]
                sizes, which = np.nonzero(better)
                came[i + 1 + sizes, which, 0] = sizes + 1
                came[i + 1 + sizes, which, 1] = before[which]
        out = []
        at, label = n, int(value[n].argmax())
        while at > 0:
            size, before = came[at, label]
            if label:
                out.append((KINDS[label - 1], lattice.spans[at - size][0], lattice.spans[at - 1][1]))
            at, label = at - int(size), int(before)
        return out[::-1]

    def learn(self, examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 12, rate: float = 0.3, keep: float = 1e-3) -> Field:
        """Climb the conditional likelihood of whole segmentations, one example after another."""
        sums = [np.full_like(self.weights, 1e-3), np.full_like(self.follow, 1e-3)]
        made = []
        for text, spans in examples:
            lattice = Lattice(text)
            begins, ends = {a: i for i, (a, _) in enumerate(lattice.spans)}, {b: i + 1 for i, (_, b) in enumerate(lattice.spans)}
            known = {begins[a]: (ends[b] - begins[a], KINDS.index(k) + 1) for k, a, b in spans}
            made.append((lattice.features(0, lattice.n), lattice.n, known))
        for _ in range(rounds):
            for features, n, known in made:
                scores = self.scores(features, np.arange(n), n)
                # ahead[i, y]: all that ends before i, and y begins there; back[i, y]: y has just ended at i
                forward, ahead = np.full((n + 1, scores.shape[2]), -np.inf), np.empty((n, scores.shape[2]))
                forward[0, 0] = 0
                for i in range(n):
                    if i:
                        sizes = np.arange(1, min(LONGEST, i) + 1)
                        forward[i] = _logsum(ahead[i - sizes] + scores[i - sizes, sizes - 1], 0)
                    ahead[i] = _logsum(forward[i][:, None] + self.follow, 0)
                sizes = np.arange(1, min(LONGEST, n) + 1)
                forward[n] = _logsum(ahead[n - sizes] + scores[n - sizes, sizes - 1], 0)
                total = _logsum(forward[n], 0)
                back, begin = np.zeros((n + 1, scores.shape[2])), np.empty((n, scores.shape[2]))
                for i in range(n - 1, -1, -1):
                    sizes = np.arange(1, min(LONGEST, n - i) + 1)
                    begin[i] = _logsum(scores[i, sizes - 1] + back[i + sizes], 0)
                    back[i] = _logsum(self.follow + begin[i], 1)
                reach = np.minimum(np.arange(n)[:, None] + np.arange(1, LONGEST + 1), n)
                share = np.exp(ahead[:, None] + scores + back[reach] - total)
                pair = np.exp(forward[:n, :, None] + self.follow + begin[:, None] - total).sum(axis=0)
                at, before = 0, 0
                truth, truth_pair = np.zeros_like(share), np.zeros_like(pair)
                while at < n:
                    size, label = known.get(at, (1, 0))
                    truth[at, size - 1, label] = 1
                    truth_pair[before, label] += 1
                    at, before = at + size, label
                slope = np.einsum("ilf,ily->fy", features, truth - share)
                slope[:, 0] = 0
                for k, (part, grad) in enumerate(((self.weights, slope), (self.follow, truth_pair - pair))):
                    grad = grad - keep * part
                    sums[k] += grad**2
                    part += rate * grad / np.sqrt(sums[k])
        return self


def examples(n: int = 300, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made sentences with marked entities, and with numbers that are none."""
    rng = random.Random(seed)
    some = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    word = lambda: some("aeiourstnlmdé", 2, 8)
    number = lambda k: some(string.digits, k, k)

    def card() -> str:
        digits = rng.choice("3456") + number(rng.choice([12, 14, 14, 14, 17]))
        digits += next(c for c in string.digits if luhn(digits + c))
        sign = rng.choice(["", "", " ", "-"])
        return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4)) if sign else digits

    def email() -> str:
        at, dot = rng.choice([("@", "."), ("@", "."), ("@", "."), (" (at) ", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", " dot ")])
        if at == " at ":
            return word().replace("é", "e") + rng.choice(["", " dot " + word().replace("é", "e")]) + at + word().replace("é", "e") + dot + rng.choice(["com", "net", "org"])
        return word().replace("é", "e") + rng.choice(["", ".", "_"]) + some(string.ascii_lowercase + string.digits, 1, 4) + at + word().replace("é", "e") + dot + rng.choice(["com", "net", "org"])

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+{rng.randint(1, 99)} {number(2)} {number(4)} {c}", f"00{rng.randint(1, 99)} {a} {b}{c}"])

    def key() -> str:
        def mixed(letters: str, k: int) -> str:
            while True:
                x = some(letters, k, k)
                if len(_digits(x)) > 3 and not x.isdigit():
                    return x

        return rng.choice([lambda: "AKIA" + mixed(string.ascii_uppercase + string.digits, 16), lambda: mixed("0123456789abcdef", rng.choice([18, 32, 40])), lambda: "sk_" + mixed(string.ascii_letters + string.digits, 24)])()

    def none() -> str:
        return rng.choice([
            lambda: str(rng.randint(1900, 2040)), lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 20)}", lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}", lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1990, 2030)}",
            lambda: f"{rng.randint(1, 23)}:{rng.randint(10, 59)}", lambda: f"{rng.randint(1, 99)},{number(3)}.{number(2)}", lambda: "1" + number(rng.choice([4, 6, 7])), lambda: f"{word()}{rng.randint(1, 99)}", lambda: f"{rng.randint(256, 999)}.{number(3)}.{rng.randint(1, 9)}.{rng.randint(300, 999)}",
            lambda: f"{rng.choice(_HINT_WORDS)} {word()}", lambda: f"{rng.choice(_HINT_WORDS)}{rng.choice([': ', ' = '])}{word()}", lambda: f"{rng.choice(_HINT_WORDS)} {number(2)}", lambda: f"{word()} at {word()}. {word()}", lambda: f"{word()} at {word()} {word()}",
            lambda: next(x for x in ("9" + number(15) for _ in range(99)) if not luhn(x)), lambda: f"@{word()}", lambda: f"{word()}@", lambda: f"{number(2)} {number(3)} {number(2)}", lambda: f"{rng.randint(1, 9)} {word()} {number(2)}", lambda: f"{number(3)}-{number(2)}",
        ])()

    makers = {"email": email, "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), "card": card, "phone": phone, "key": key}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 3))) + " "
            if rng.random() < 0.5:
                kind = rng.choice(list(makers))
                entity = makers[kind]()
                lead, after = "", ""
                if kind == "key":
                    lead, after = rng.choice([("", ""), ("password=", ""), ('token = "', '"'), ("secret: ", ""), ("api key ", "")])
                    if lead not in ("", "api key ") and rng.random() < 0.4:
                        entity = rng.choice([lambda: some(string.ascii_lowercase, 12, 30), lambda: some(string.ascii_letters, 4, 8) + number(2)])()
                text += lead
                spans.append((kind, len(text), len(text) + len(entity)))
                text += entity + after
            else:
                text += none()
            text += rng.choice([" ", ". ", ", ", "\n"])
        out.append((text + word(), spans))
    return out


@functools.lru_cache(maxsize=1)
def trained() -> Field:
    """The field as learned from the made sentences: the same on every run."""
    return Field().learn(examples())


def _anchors(text: str) -> list[tuple[int, int]]:
    """Digits and at signs, at signs that are spelt, and hints: what a segment that may be an entity has in it, or before it."""
    found = [m.span() for m in _NUMBER_OR_AT.finditer(text)]
    more = [m.span() for m in _SPELT.finditer(text)] if "at)" in text or "at]" in text or " dot " in text else []
    low = text.lower()
    if any(w in low for w in ("pass", "pwd", "token", "secret", "api", "key", "credential", "auth")):
        more += [m.span() for m in _HINTS.finditer(text)]
    return sorted(found + more) if more else found


def _tokens_before(text: str, at: int, n: int) -> int:
    """Where the token begins that is n tokens before the one at `at`."""
    reach = 512
    while True:
        low = max(0, at - reach)
        found = [m.start() for m in _TOKENS.finditer(text, low, at)]
        if len(found) > n + 2 or low == 0:  # the first may be the rest of a word
            return found[max(-n - 2, -len(found))] if found else 0
        reach *= 8


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """The tokens that a segment with an anchor in it, or its features, can reach.

    All other segments can't be entities (`Field.scores`), and what the features
    look at is in the stretch. So the field's best segmentation of the whole
    text is that of its stretches, and single tokens elsewhere.
    """
    start = end = word_end = -1
    for a, b in _anchors(text):
        if a < word_end:
            continue  # a word that has been told
        if a >= end:
            low = _tokens_before(text, a, CONTEXT)
            if end < 0 or low >= end:
                if end >= 0:
                    yield start, end
                start = low
        after = [m.end() for m in itertools.islice(_TOKENS.finditer(text, b), CONTEXT + 1)]
        word_end, end = after[0] if after else b, max(end, b, *after[-1:])
    if end >= 0:
        yield start, end


def _joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(text: str, field: Field) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether a pattern found it), by kind as listed and start. Base spans stay; the field adds what overlaps none."""
    base = base_spans(text)
    taken = _joined((a, b) for _, a, b in base)
    added = [(kind, lo + a, lo + b) for lo, hi in stretches(text) for kind, a, b in field.best(text[lo:hi])]
    free, k = [], 0
    for kind, a, b in added:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            free.append((kind, a, b))
    rank = {x: i for i, x in enumerate(KINDS)}
    return sorted([(*s, True) for s in base] + [(*s, False) for s in free], key=lambda s: (rank[s[0]], s[1], s[2]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of each whole text; spans: array of (kind, start, end, base) in code points, end exclusive.

    The patterns for email, ip, card and phone give the base spans. The field
    segments the whole text, whole spans scored by their features, with
    boundaries and kinds chosen together; of its entities those that overlap no
    base span are added. Its dynamic program is worked out where a segment may
    be an entity (`stretches`), which gives what it gives on the whole text.

    Null text counts as empty and has no spans; equal texts have equal spans;
    texts and words of any length are read whole; repeated rows and null ids
    stay; an empty table gives no rows; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(trained())  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [[{"kind": k, "start": a, "end": b, "base": own} for k, a, b, own in find(x.as_py() or "", held.value)] for x in part.column(1)]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def told(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span replaced by its kind in angle brackets; spans that overlap become one, of the first's kind."""
    out, at = [], 0
    for kind, a, b in sorted(((k, a, b) for k, a, b, _ in spans), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs`, all columns, with personal data in the text, as `find_pii` has it, replaced by its kind.

    Null and empty texts stay; repeated rows stay, each redacted alike; an empty
    table gives no rows; other columns, whatever their names, aren't touched.
    """
    held = docs.sparkSession.sparkContext.broadcast(trained())
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = (x.as_py() for x in part.column(at))
                new = pa.array([x and redact(x, find(x, held.value)) for x in texts], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], new, *part.columns[at + 1 :]], part.schema.names)

    return docs.mapInArrow(run, docs.schema)

"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans of other kinds."""

from __future__ import annotations

import bisect
import collections
import functools
import heapq
import math
import random
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
#: What the random field adds. Kinds follow the base kinds in order.
ADDED = ("secret", "iban", "national_id", "local_phone", "person", "account")
KINDS = (*BASE, *ADDED)
SPANS = "array<struct<kind:string,start:int,stop:int,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails as a whole fails from each of its later digits too, so only its first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans of a text, leftmost and without overlap within a kind, by start and kind."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append(("email", start, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(int(x) <= 255 for x in m[0].split(".") if len(x.lstrip("0")) <= 3) and all(len(x.lstrip("0")) <= 3 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# The random field. A text's tokens are cut into segments: base spans as they are, entities of at most
# LONGEST tokens, each of a kind, and single tokens outside. An entity holds a digit, or is a word that
# a cue for secrets assigns, or capitalised words after a cue for names; only around digits and cues
# are segments scored, and everything else lies outside under any weights.
LONGEST, NAME_TOKENS = 12, 4
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
TITLES = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "señor", "señora", "monsieur", "madame")
CUES = {
    "secret": ("token", "secret", "key", "password", "passwd", "pwd", "passwort", "apikey", "bearer", "credential"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "passport", "id", "dni", "nir"),
    "local_phone": ("phone", "tel", "call", "telefon", "mobile", "fax", "téléphone", "teléfono"),
    "person": (*TITLES, "name", "contact", "dear", "sincerely", "regards", "signed"),
    "account": ("card", "account", "number", "karte", "carte", "tarjeta"),
}
CUE_BITS = {w: sum(1 << ADDED.index(k) for k, ws in CUES.items() if w in ws) for ws in CUES.values() for w in ws}
#: Words that open a region even without a digit near them.
OPENERS = (*CUES["secret"], *CUES["person"])
SECRET, PERSON = 1 << ADDED.index("secret"), 1 << ADDED.index("person")
TITLE, ASSIGNED, CUT_LEFT, BESIDE_BASE = (1 << (len(ADDED) + i) for i in range(4))
#: How far a region reaches beyond its seeds, in code points.
REACH = 80
_DIGITS = re.compile(r"[0-9]+")
_OPENS = re.compile(r"\b(?i:" + "|".join(OPENERS) + r")\b")
_SHAPE = {c: k for k, cs in (("9", range(48, 58)), ("A", (*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF))), ("a", (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)))) for c in cs}
_RUN = re.compile(r"(.)\1+")
_FORMS = tuple((name, re.compile(form)) for name, form in (
    ("key_like", r"(?=.*9)(?=.*[aA])[9aA]{20,}|(?=.*9)(?=.*[aA])[9aA_-]{24,}"), ("upper_key", r"(?=.*9)(?=.*A)[9A]{16,}"), ("prefixed_key", r"[aA]{2,}(_[aA]+)*[_-](?=.*9)[9aA]{10,}"),
    ("uuid", r"[9aA]{8}(-[9aA]{4}){3}-[9aA]{12}"), ("three_two_four", r"9{3}-9{2}-9{4}"), ("phone_like", r"\(?9{2,4}\)?[ /-]9{3,4}[ -]9{3,4}"), ("pairs", r"9{2}([-. ]9{2}){4}"),
    ("long_number", r"9{12,19}|9{4}([ -]9{4}){2,4}"), ("date_like", r"9{4}-9{2}-9{2}|9{1,2}[./]9{1,2}[./]9{2,4}"), ("clock", r"9{1,2}:9{2}(:9{2})?"), ("name_like", r"Aa+( Aa+){0,2}"), ("word", r"[aA]+"), ("mixed_word", r"(?=.*9)(?=.*[aA])[9aA]+"),
))


def _iban(chars: str) -> bool:
    chars = re.sub(r"\W", "", chars)
    if not 15 <= len(chars) <= 34 or not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]+", chars):
        return False
    return int("".join(str(int(c, 36)) for c in chars[4:] + chars[:4])) % 97 == 1


Key = tuple[int, bool, int, bool, str]


def segment_features(key: Key) -> list[str]:
    """Features of a whole span: what stands before it, whether it is cut off on the right, its number of tokens, whether its check digits hold, and its shape (9 for digits, a and A for letters)."""
    before, cut_right, n, check, shape = key
    digits, letters = shape.count("9"), shape.count("a") + shape.count("A")
    short = _RUN.sub(r"\1+", shape)
    groups = "-".join(str(len(g)) for g in re.findall(r"9+", shape)[:6])
    out = [f"shape={short}" if len(short) < 14 else "shape=long", f"digits={min(digits, 12)}", f"groups={groups}", f"tokens={min(n, 8)}", f"letters={min(letters, 6)}"]
    cues = [kind for i, kind in enumerate(ADDED) if before >> i & 1]
    forms = [name for name, form in _FORMS if form.fullmatch(shape)]
    out += [f"cue={kind}" for kind in cues] + forms + [f"{name}&{kind}" for name in forms for kind in cues]
    out += [name for name, bit in (("after_title", TITLE), ("assigned", ASSIGNED), ("cut_left", CUT_LEFT), ("beside_base", BESIDE_BASE)) if before & bit]
    if before & ASSIGNED and before & SECRET:
        out.append("assigned_secret_long" if len(shape) >= 6 else "assigned_secret")
        if " " in shape:
            out.append("secret_in_two")
    if check:
        out.append("iban_check")
    if re.search(r"\s\s|\n", shape):
        out.append("gap")
    if cut_right:
        out.append("cut_right")
    return out


def _seeds(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digits and opening cues, in order."""
    low = text.lower()
    if len(low) == len(text):
        at = []
        for word in OPENERS:
            k = low.find(word)
            while k >= 0:
                end = k + len(word)
                if not (k and low[k - 1].isalnum()) and not low[end : end + 1].isalnum():
                    at.append((k, end))
                k = low.find(word, end)
    else:
        at = [m.span() for m in _OPENS.finditer(text)]
    return heapq.merge((m.span() for m in _DIGITS.finditer(text)), sorted(at))


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of the text within reach of seeds, apart from each other, cut at the ends of words."""
    left = right = -1
    for start, end in _seeds(text):
        if right >= 0 and start <= right + REACH:
            right = max(right, end)
            continue
        if right >= 0:
            yield _whole_words(text, left, right)
        left, right = max(start - REACH, right + REACH if right >= 0 else 0), end
    if right >= 0:
        yield _whole_words(text, left, right)


def _whole_words(text: str, left: int, right: int) -> tuple[int, int]:
    right = min(len(text), right + REACH)
    while left and text[left - 1].isalnum() and text[left : left + 1].isalnum():
        left += 1
    while right < len(text) and text[right].isalnum():
        right += 1
    return left, right


def candidates(text: str, left: int, right: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, Key]]]]:
    """Each token of a region, with the entities that may end with it: how many tokens they have, and their key. ``taken`` are the base spans in order, which no entity touches or bridges."""
    shape = text[left:right].translate(_SHAPE)
    recent: collections.deque = collections.deque(maxlen=LONGEST)  # start, context, may begin, digits, is capitalised
    words: collections.deque = collections.deque(maxlen=4)
    base, last, beside = 0, left, 0
    for m in TOKEN.finditer(text, left, right):
        start, end = m.span()
        while base < len(taken) and taken[base][1] <= start:
            base += 1
        if base < len(taken) and taken[base][0] < end:
            recent.clear()
            words.append("")
            last, beside = end, BESIDE_BASE
            yield start, end, []
            continue
        if start - last > 1:
            recent.clear()
        before = beside
        for w in words:
            before |= CUE_BITS.get(w, 0)
        near = list(words)[-2:]
        if near and (near[-1] in TITLES or (near[-1] == "." and near[0] in TITLES)):
            before |= TITLE
        if any(w in ("=", ":") for w in words):
            before |= ASSIGNED
        if start and not text[start - 1].isspace() and text[start - 1] not in "(\"'=:":
            before |= CUT_LEFT
        first = shape[start - left]
        word = m[0].isalnum()
        recent.append((start, before, word or first == "(", shape.count("9", start - left, end - left), first == "A"))
        words.append(m[0].lower())
        last, beside = end, 0
        found = []
        if word:
            after = text[end : end + 1]
            cut_right = bool(after) and not after.isspace() and after not in ".,;:!?)\"'"
            digits, capitals = 0, True
            for n, (a, context, begins, own, capital) in enumerate(reversed(recent), 1):
                digits, capitals = digits + own, capitals and capital
                if not begins:
                    continue
                if not digits:
                    if not (capitals and n <= NAME_TOKENS and context & PERSON) and not (n == 1 and context & SECRET and context & ASSIGNED):
                        if n >= NAME_TOKENS and not any(x[3] for x in recent):
                            break
                        continue
                    found.append((n, (context, cut_right, n, False, shape[a - left : end - left])))
                    continue
                span = shape[a - left : end - left]
                bank = span.startswith("AA99")
                lettered = "a" in span or "A" in span
                # Words and numbers in one entity stand without blanks, but for bank accounts; numbers alone have 19 digits at most.
                if bank or (not any(map(str.isspace, span)) if lettered else digits <= 19):
                    found.append((n, (context, cut_right, n, bank and _iban(text[a:end]), span)))
        yield start, end, found


class SemiMarkovField:
    """Weights by feature and kind; outside tokens score zero."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.weights = weights
        self.none = np.zeros(len(ADDED))
        self.seen: dict[Key, tuple[int, float]] = {}

    def score(self, features: list[str]) -> np.ndarray:
        return sum((self.weights.get(f, self.none) for f in features), start=self.none)

    def best(self, key: Key) -> tuple[int, float]:
        """The best kind of a segment and its score. Many segments look alike, so that these are kept."""
        found = self.seen.get(key)
        if found is None:
            score = self.score(segment_features(key))
            found = int(score.argmax()), float(score.max())
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[key] = found
        return found

    def decode(self, text: str, left: int, right: int, taken: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
        """The entities of the best segmentation of a region.

        Only what the paths that may still win do not share is held: every few thousand tokens they
        are followed back to where they meet, and what lies before is settled.
        """
        starts, ends = array("q"), array("q")
        best, size, kind = array("d", [0.0]), array("b", [0]), array("b", [0])

        def settle(j: int) -> list[tuple[str, int, int]]:
            out = []
            while j:
                if size[j]:
                    out.append((ADDED[kind[j]], starts[j - size[j]], ends[j - 1]))
                j -= max(1, size[j])
            return out[::-1]

        for start, end, found in candidates(text, left, right, taken):
            starts.append(start)
            ends.append(end)
            j = len(starts)
            top, long, which = best[j - 1], 0, 0
            for n, key in found:
                k, s = self.best(key)
                if best[j - n] + s > top:
                    top, long, which = best[j - n] + s, n, k
            best.append(top)
            size.append(long)
            kind.append(which)
            if j % BLOCK == 0:
                heads = set(range(j - LONGEST, j + 1))
                while len(heads) > 1:
                    h = max(heads)
                    heads.remove(h)
                    heads.add(h - max(1, size[h]))
                meet = heads.pop()
                yield from settle(meet)
                starts, ends, best, size, kind = starts[meet:], ends[meet:], best[meet:], size[meet:], kind[meet:]
                size[0] = 0
        yield from settle(len(starts))


#: Tokens after which a region's settled part is given out.
BLOCK = 4096


def _example(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A made-up line with at most two entities, and hard cases without any."""
    words = "the of and report visit made green river paper some note about there when until market open small first".split()
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    chars = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    low, up, number = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    assign = lambda: rng.choice([" = ", ": ", "=", ' = "', ': "', '="'])
    secrets = (
        lambda: (rng.choice(["token", "api key", "password", "secret key", "TOKEN", "key"]) + rng.choice([assign(), " "]), chars(rng.choice([24, 32, 40, 64]), rng.choice(["0123456789abcdef", "0123456789ABCDEF", low + number]))),
        lambda: (rng.choice(["password", "passwd", "pwd", "passwort", "secret"]) + assign(), chars(rng.randint(3, 9), low) + digits(rng.randint(1, 4))),
        lambda: (rng.choice(["password", "passwd", "secret"]) + assign(), chars(rng.randint(8, 26), low)),
        lambda: (rng.choice(["", "key ", "use "]), rng.choice(["AK", "AS"]) + chars(18, up + number)),
        lambda: (rng.choice(["", "key ", "token: "]), rng.choice(["sk", "pk", "ghp", "xoxb", "sk_live"]) + rng.choice("_-") + chars(rng.randint(16, 36), low + up + number)),
        lambda: (rng.choice(["api key ", "token ", "secret "]) + rng.choice(["", ": "]), "-".join(chars(n, "0123456789abcdef") for n in (8, 4, 4, 4, 12))),
    )
    made = {
        "secret": lambda: rng.choice(secrets)(),
        "iban": lambda: (rng.choice(["IBAN ", "account ", ""]), _make_iban(rng)),
        "national_id": lambda: (rng.choice(["SSN ", "social security ", "id ", "ssn: ", ""]), f"{digits(3)}-{digits(2)}-{digits(4)}"),
        "local_phone": lambda: (rng.choice(["call ", "phone ", "tel. ", "fax: ", ""]), rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", "-".join(digits(2) for _ in range(5))])) if rng.random() < 0.8 else (rng.choice(["tel. ", "call ", "fax: "]), " ".join(digits(2) for _ in range(5))),
        "person": lambda: (rng.choice(["Mr. ", "Mrs. ", "Dr. ", "Herr ", "Frau ", "Ms ", "Prof. ", "contact ", "name: ", "Dear ", "signed "]), " ".join(_make_name(rng) for _ in range(rng.choice([1, 2, 2, 3])))),
        "account": lambda: (rng.choice(["", "card ", "number ", "account: "]), rng.choice([digits(rng.choice([12, 13, 16, 16, 16, 18])), " ".join(digits(4) for _ in range(rng.randint(3, 5))), "-".join(digits(4) for _ in range(4))])),
        "": lambda: (rng.choice(["", "in ", "page ", "token ", "call ", "The ", "key ", "password ", "name ", "contact ", "secret: "]), rng.choice([
            digits(4), digits(2), f"{digits(2)}.{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(1)},{digits(3)}", "a1b2", f"{digits(3)}.{digits(2)}.{digits(2)}.{digits(3)}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}",
            f"x.{digits(2)}@mail{digits(1)}.example.com", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(rng.randint(5, 8))}", f"{digits(2)}-{digits(2)}", f"{digits(1)} to {digits(2)}", f"of the {rng.choice(words)}", f"is {rng.choice(words)}", f"{rng.choice(words)} {digits(3)} {rng.choice(words)}", f"{digits(3)} {digits(2)} {digits(1)}", " ".join(digits(2) for _ in range(rng.randint(4, 8))), " ".join(digits(rng.randint(1, 5)) for _ in range(6)),
        ])),
    }
    text, spans = pick(rng.randint(0, 4)), []
    for _ in range(rng.randint(1, 2)):
        kind = rng.choice([*ADDED, "", "", ""])
        before, value = made[kind]()
        text = f"{text} {before}".lstrip()
        if kind and not base_spans(value):
            spans.append((kind, len(text), len(text) + len(value)))
        text += value + ('"' if before.endswith('"') else "") + rng.choice(["", "", ".", ","]) + " " + rng.choice(["", "", "The ", "And "]) + pick(rng.randint(0, 4))
    return text.rstrip(), spans


def _make_name(rng: random.Random) -> str:
    name = "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    return name.capitalize()


def _make_iban(rng: random.Random) -> str:
    country, body = rng.choice(["DE", "FR", "ES", "GB"]), "".join(rng.choice("0123456789") for _ in range(rng.randint(16, 20)))
    check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
    whole = f"{country}{check:02d}{body}"
    return whole if rng.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))


def union(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


@functools.lru_cache(maxsize=2)
def fit_field(examples: int = 1200, epochs: int = 5, rate: float = 0.25, decay: float = 1e-3, seed: int = 11) -> SemiMarkovField:
    """Fits the field on made-up lines, by stochastic ascent of the conditional likelihood (forward and backward sums over all segmentations, base spans fixed)."""
    rng, field = random.Random(seed), SemiMarkovField({})
    lines = []
    for _ in range(examples):
        text, spans = _example(rng)
        taken = union(base_spans(text))
        for left, right in regions(text):
            tokens, segments = [], []
            for start, end, found in candidates(text, left, right, taken):
                tokens.append((start, end))
                j = len(tokens)
                segments += [(j - n, j, segment_features(key)) for n, key in found]
            begin, stop = {a: k for k, (a, _) in enumerate(tokens)}, {b: k + 1 for k, (_, b) in enumerate(tokens)}
            gold = {(begin[a], stop[b]): ADDED.index(kind) for kind, a, b in spans if a in begin and b in stop}
            lines.append((len(tokens), segments, [gold.get((i, j), -1) for i, j, _ in segments]))
    for epoch in range(epochs):
        rng.shuffle(lines)
        step = rate / (1 + epoch)
        for n, segments, gold in lines:
            score = [field.score(f) for _, _, f in segments]
            forward, backward = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
            forward[0] = backward[n] = 0.0
            total = [_log_sum(s.tolist()) for s in score]
            ends: dict[int, list] = {}
            begins: dict[int, list] = {}
            for k, (i, j, _) in enumerate(segments):
                ends.setdefault(j, []).append((i, total[k]))
                begins.setdefault(i, []).append((j, total[k]))
            for j in range(1, n + 1):
                forward[j] = _log_sum([forward[j - 1], *(forward[i] + s for i, s in ends.get(j, ()))])
            for i in range(n - 1, -1, -1):
                backward[i] = _log_sum([backward[i + 1], *(backward[j] + s for j, s in begins.get(i, ()))])
            for k, (i, j, features) in enumerate(segments):
                slope = -np.exp(np.minimum(score[k] + forward[i] + backward[j] - forward[n], 0.0))
                if gold[k] >= 0:
                    slope[gold[k]] += 1
                if np.abs(slope).max() > 1e-3:
                    for f in features:
                        own = field.weights.get(f)
                        if own is None:
                            own = field.weights[f] = np.full(len(ADDED), -0.2)
                        own += step * (slope - decay * own)
    return field


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top if len(values) == 1 or top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def added_spans(text: str, field: SemiMarkovField, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """What the field finds beside the base spans, which it keeps as segments of their own."""
    taken = union(base)
    for left, right in regions(text):
        first, last = bisect.bisect_right(taken, left, key=lambda t: t[1]), bisect.bisect_left(taken, right, key=lambda t: t[0])
        yield from field.decode(text, left, right, taken[first:last])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of personal data in each text, in code points.

    Base spans follow fixed patterns and stay. The field takes them as segments that are settled,
    cuts what else lies near digits and cues into segments, scores whole segments by kind, and adds
    the entities of its best segmentation; its kinds (``ADDED``) are other than the base kinds.
    Every text is read to its end, a token at a time, so that a long one takes no more memory. A
    null or empty text has no spans. Repeated rows give repeated results, an empty table none; other
    columns are ignored.

    Returns ``doc_id, spans`` (kind, start, stop, base), ordered by start, then kind as in ``KINDS``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_field())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = [(k, a, b, True) for k, a, b in base] + [(k, a, b, False) for k, a, b in added_spans(text, shared.value, base)]
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                out.append([{"kind": k, "start": a, "stop": b, "base": x} for k, a, b, x in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans {SPANS}")

"""Secret scan: patterns propose findings, a random forest dismisses false ones.

The forest sees length, character transitions, dictionary coverage, path and neighbouring words of a finding. It
is trained on labelled findings: by default on `labelled_findings`, which makes them up from formats of secrets
and of what is taken for them; a table of one's own can be given instead.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import in_small_batches, rows
from quire.llm.forest import Forest

#: Labelled findings that the forest is trained on at most.
TRAIN_FINDINGS = 20_000
THRESHOLD = 0.5
CONTEXT = 60

# A whole identifier that holds a keyword, and the separator after it. Each identifier is read from its start only, and
# searched for keywords only before a separator, so time is in proportion to the text.
_SEPARATOR = r"[\"']?\]?\s{0,3}[:=]"
_KEYWORD = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)"
_NAME = rf"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++{_SEPARATOR})(?=[A-Za-z0-9_-]*?{_KEYWORD})[A-Za-z0-9_-]++{_SEPARATOR}"

# Patterns of findings, in order of precedence; group `v` is the value.
PATTERNS = (
    ("aws_key_id", r"\b(?P<v>(?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    ("prefixed", r"\b(?P<v>(?:gh[opsu]|glpat|xox[abp]|sk_live|sk_test|pk_live)[_-][A-Za-z0-9_-]{16,})"),
    ("jwt", r"\b(?P<v>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    ("private_key", r"(?P<v>-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)"),
    ("assigned", _NAME + r"\s{0,3}[\"']?(?i:(?:bearer|basic)\s{1,3})?(?P<v>[^\s\"'<>,;]{6,})"),
    ("hex", r"\b(?P<v>[0-9a-f]{32,}|[0-9A-F]{32,})\b"),
    ("base64", r"(?<![A-Za-z0-9+/_-])(?P<v>[A-Za-z0-9+/]{32,}={0,2})(?![A-Za-z0-9+/_=-])"),
)
_FOUND = [(kind, re.compile(p)) for kind, p in PATTERNS]

# Words that speak for or against a secret beside a finding, and common parts of harmless values.
FOR = "password passwd pwd secret token key api auth credential credentials bearer login aws access private".split()
AGAINST = "sha sha1 sha256 md5 checksum digest commit revision hash uuid guid id example sample test dummy placeholder etag version".split()
DICTIONARY = """
    about after access admin again all also and are auth back bar bearer because been before bucket build but can change
    changeme code come config could data date day default demo dummy each end enter environ example false file find first
    foo for from get give global good great hello here hidden his home how input insert its just key know like
    local login look made main make many master mock more most name new none null number object only other
    over parameter password path people phrase place please public read replace required root sample secret see self
    some string such system take temp test text than that the their them then there these they thing think this time
    todo token true undefined user username value variable want welcome what when which will with word work world would
    write year you your
""".split()
_WORD = re.compile("|".join(sorted(DICTIONARY, key=len, reverse=True)))
_CLASS = {**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", 0), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), **dict.fromkeys("0123456789", 2)}

FEATURES = (
    "length", "entropy", "class_changes", "vowel_pairs", "digits", "upper", "symbols", "distinct", "longest_run",
    "sequence_steps", "dictionary", "path", "placeholder", "uuid", "hex_only", "words_for", "words_against", "kind",
)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of findings in a whole text, in order; a stretch is found once, by the first pattern."""
    starts: list[int] = []
    found: list[tuple[str, int, int]] = []
    for kind, pattern in _FOUND:
        for m in pattern.finditer(text):
            a, b = m.span("v")
            # What was found is disjoint, so only the last that begins before b can overlap.
            at = bisect_left(starts, b)
            if not at or found[at - 1][2] <= a:
                starts.insert(at, a)
                found.insert(at, (kind, a, b))
    return found


def features(kind: str, value: str, before: str, after: str) -> list[float]:
    n = len(value)
    classes = [_CLASS.get(c, 3) for c in value]
    counts = {c: value.count(c) for c in set(value)}
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    lower, runs, steps, longest = value.lower(), 1, 0, 1
    for a, b in zip(lower, lower[1:], strict=False):
        runs = runs + 1 if a == b else 1
        longest = max(longest, runs)
        steps += abs(ord(b) - ord(a)) == 1
    pairs = sum((a in "aeiou") != (b in "aeiou") for a, b in zip(lower, lower[1:], strict=False) if a.isalpha() and b.isalpha())
    covered = sum(len(m[0]) for m in _WORD.finditer(lower))
    near = re.findall(r"[a-z0-9]+", before.lower())[-6:] + re.findall(r"[a-z0-9]+", after.lower())[:3]
    return [
        float(n),
        entropy,
        sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / max(1, n - 1),
        pairs / max(1, n - 1),
        classes.count(2) / n,
        classes.count(1) / n,
        classes.count(3) / n,
        len(counts) / n,
        longest / n,
        steps / max(1, n - 1),
        covered / n,
        float("/" in value or "\\" in value or before.endswith(("/", "\\")) or bool(re.search(r"\.[a-z]{2,4}$", value))),
        float(bool(re.search(r"[<>{}$%*]|x{4,}|\.\.\.|_here|your", lower))),
        float(bool(re.fullmatch(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", lower))),
        float(bool(re.fullmatch(r"[0-9a-f]+", lower))),
        float(sum(w in FOR for w in near)),
        float(sum(w in AGAINST for w in near)),
        float([k for k, _ in PATTERNS].index(kind)),
    ]


# Words that made-up findings are made of, chosen apart from those that features count, of which they
# hold a part.
PLAIN = """
    account action address agent apply array asset backup batch block book border branch bridge button cache call
    camera center channel choose client cloud common connect content context copy count create current customer
    database debug delete detail device display document domain down download empty engine error event every export
    extra factory field filter folder font form frame function group guide handle head header house image import
    index info item job label language last layer layout letter level library light line link list load lock loop
    machine manager map market match member menu message method middle minute mode model module move network next
    night note notes office open option order owner package page panel paper parent parse part paste plan policy
    portal post power price print process product profile project prompt query queue question random range record
    refresh region release remote report request reset resource response result review score screen script search
    section select server service session setting share shop show side sign signal simple size skip sleep small
    smart sort source space stage start state station status step stop storage style support switch table target
    task team ticket title tool total track type update video view web window
""".split()
SECRET_NEAR = "secret key bearer credential token vault signing deploy login signature licence pin master encryption".split()
PLAIN_NEAR = "md5 checksum etag digest commit sha1 revision hash sha256 blob fingerprint build trace parent object asset tree".split()


def labelled_findings(n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(kind, value, before, after, label): made up, half of them secrets; the same for each call."""
    rng = random.Random(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    upper, hexa = lower.upper(), digits + "abcdef"
    some = lambda alphabet, a, b=None: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b or a)))
    prose = lambda: " ".join(some(lower, 2, 9) for _ in range(rng.randint(0, 8))) + " " * rng.randint(0, 1)
    assign = lambda words: rng.choice(words) + rng.choice(["=", " = ", ": ", ' = "', "='"])
    keyword = lambda: rng.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apiKey", "access_key", "auth"])
    parts = lambda found: found + [""] * len(found)
    long_name = lambda: rng.choice(parts(["db_", "aws_", "client_", "my-", "x-", "user"])) + keyword() + rng.choice(parts(["_key", "_value", "2", "-prod"]))
    named = lambda: assign([rng.choice([str.lower, str.upper, str])(long_name())])
    spoken = lambda a, b: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice(["a", "e", "i", "o", "u", "er", "an", "ou"]) for _ in range(rng.randint(a, b)))
    camel = lambda a, b: rng.choice(["", "", some(upper, 2, 4)]) + "".join(rng.choice(PLAIN).capitalize() for _ in range(rng.randint(a, b)))
    near = lambda found, ends=" ": rng.choice(found) + rng.choice(ends)
    words = lambda a, b: rng.choice(["", "_", "-"]).join(rng.choice(PLAIN) for _ in range(rng.randint(a, b)))
    true = (
        lambda: ("aws_key_id", "AKIA" + some(upper + digits, 16), prose() + rng.choice(["", "aws key ", "access "])),
        lambda: ("aws_key_id", "AKIA" + some(upper + rng.choice(["", "27"]), 16), prose() + rng.choice(["", "aws key ", "access "])),
        lambda: ("prefixed", rng.choice(["ghp_", "sk_live_", "glpat-", "xoxb-"]) + some(lower + upper + digits, 20, 40), prose()),
        lambda: ("jwt", ".".join(["eyJ" + some(lower + upper + digits, 15, 30), some(lower + upper + digits, 20, 60), some(lower + upper + digits + "_-", 30, 43)]), prose()),
        lambda: ("private_key", "-----BEGIN " + rng.choice(["", "RSA ", "EC "]) + "PRIVATE KEY-----", prose()),
        lambda: ("assigned", some(hexa, 16, 64), prose() + named()),
        lambda: ("assigned", some(digits + hexa, 14, 32), prose() + named()),
        lambda: ("assigned", some(lower + upper + digits + "!#%&*+-", 10, 40), prose() + named()),
        lambda: ("assigned", some(lower + upper + digits, 9, 24), prose() + named()),
        lambda: ("assigned", some(lower + upper + digits + "+/", 32, 64), prose() + named()),
        lambda: ("base64", some(lower + upper + digits + "+/", 32, 64), prose() + near(SECRET_NEAR)),
        lambda: ("base64", some(lower + upper + "+/", 32, 64), prose() + near(SECRET_NEAR, " =")),
        lambda: ("base64", some(lower + upper + digits + "+/", 32, 86) + rng.choice(["", "=", "=="]), prose() + rng.choice(["AccountKey=", "ENCRYPTION_KEY=", "signing=", "key="])),
        lambda: ("hex", some(hexa, 32, 64), prose() + near(SECRET_NEAR)),
        lambda: ("hex", some(hexa, 32, 64), prose() + near(SECRET_NEAR, "= ")),
    )
    false = (
        lambda: ("aws_key_id", "AKIA" + rng.choice(["IOSFODNN7EXAMPLE", "X" * 16, "EXAMPLE" + "0" * 9, "1234567890123456"]), prose()),
        lambda: ("assigned", rng.choice(["your_", "<", "${", "%", "my_", ""]) + words(2, 4) + rng.choice(["", ">", "}", "_here"]), prose() + named()),
        lambda: ("assigned", rng.choice(["os.environ", "config.get", "settings.", "self.", "process.env."]) + words(1, 2), prose() + named()),
        lambda: ("assigned", rng.choice("x*0a.") * rng.randint(6, 24), prose() + named()),
        lambda: ("assigned", rng.choice(["123456", "12345678", "abcdefgh", "qwertyui", "abcd1234"]), prose() + named()),
        lambda: ("assigned", rng.choice(["/etc/", "/home/", "./", "C:\\"]) + words(1, 2) + "/" + words(1, 2) + rng.choice([".txt", ".pem", ".yml"]), prose() + named()),
        lambda: ("assigned", rng.choice([str, str.capitalize])(spoken(3, 6)) + rng.choice(["", "", ".", ")", ":"]), prose() + named()),
        lambda: ("assigned", some(digits, 6, 9), prose() + named()),
        lambda: ("assigned", "https://" + spoken(2, 4) + rng.choice([".com/", ".org/"]) + words(1, 3), prose() + named()),
        lambda: ("assigned", rng.choice([words, camel])(2, 3) + rng.choice(["()", "(", "(self)", "[0]", ""]), prose() + named()),
        lambda: ("hex", some(hexa, 32), prose() + near(PLAIN_NEAR)),
        lambda: ("hex", some(hexa, 40), prose() + near(PLAIN_NEAR)),
        lambda: ("hex", some(hexa, 64), prose() + near(PLAIN_NEAR, " :")),
        lambda: ("hex", rng.choice(hexa) * rng.randint(32, 48), prose()),
        lambda: ("base64", words(6, 9).replace("_", "/").replace("-", "/") + some(digits, 0, 2), prose() + rng.choice(["path ", "see /", "path=", ""])),
        lambda: ("base64", camel(7, 10) + some(digits, 0, 1), prose() + rng.choice(["class ", "name=", ""])),
        lambda: ("base64", spoken(15, 20), prose() + rng.choice(["name=", ""])),
    )
    out = []
    for i in range(n):
        kind, value, before = rng.choice(true if i % 2 else false)()
        out.append((kind, value, before, rng.choice(["", '"', " "]) + prose(), i % 2))
    return out


def trained(labelled: DataFrame | None = None) -> Forest:
    """A forest from labelled findings (kind, value, before, after, label); TRAIN_FINDINGS of them at most.

    Of a larger table, those with the smallest hash are taken.
    """
    if labelled is None:
        found = labelled_findings()
    else:
        order = F.xxhash64("kind", "value", "before", "after")
        few = labelled.select("kind", "value", "before", "after", "label").orderBy(order, "label").limit(TRAIN_FINDINGS)
        found = [tuple(r) for r in few.collect() if r["value"] and r["label"] is not None]
    x = np.array([features(kind, value, before or "", after or "") for kind, value, before, after, _ in found])
    return Forest(x, np.array([label for *_, label in found], float))


_FINDINGS = "doc_id long, start long, length long, kind string, score double, secret boolean, fingerprint string"


def secret_findings(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each finding in each row of docs (doc_id, text).

    start and length are in code points, score is the forest's share of votes for a secret, fingerprint the first
    16 hex digits of the value's SHA-256; the value itself is not returned. Null and empty texts have no
    findings; repeated rows give their findings again; a row without doc_id gives findings without one; no rows
    give no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest or trained())

    def scan(batches):
        for batch in rows(batches):
            out, x = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for kind, a, b in candidates(text or ""):
                    value = text[a:b]
                    x.append(features(kind, value, text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]))
                    out.append((doc_id, a, b - a, kind, hashlib.sha256(value.encode()).hexdigest()[:16]))
            if not out:
                continue
            scores = shared.value.predict(np.array(x))
            doc_ids, starts, lengths, kinds, prints = (list(c) for c in zip(*out, strict=True))
            columns = [
                pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                pa.array(kinds, pa.string()), pa.array(scores), pa.array(scores >= threshold), pa.array(prints, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _FINDINGS.split(", ")])

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, _FINDINGS)

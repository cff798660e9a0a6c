"""Licence notices, identifier tags and licence expressions in whole texts.

One Aho-Corasick automaton over word sequences finds notice phrases and identifier tags in a single
pass; what follows a tag is read as a licence expression by a shunting-yard parser, which puts WITH
before AND before OR, and evaluated against a set of accepted licences.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from groundwork.llm.arrow import map_rows, schema_with
from groundwork.llm.registry import query, table
from groundwork.llm.words import ALNUM, LOWER

#: Fixed values of the contract: phrase and label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices, ours: phrase, label, weight as evidence.
NOTICES = [
    ("gnu lesser general public license", "lgpl", 0.9),
    ("gnu affero general public license", "agpl", 0.9),
    ("gnu general public license version 2", "gpl-2.0", 0.9),
    ("gnu general public license version 3", "gpl-3.0", 0.9),
    ("apache license version 2 0", "apache-2.0", 0.9),
    ("mozilla public license", "mpl", 0.9),
    ("eclipse public license", "epl", 0.9),
    ("bsd license", "bsd", 0.8),
    ("isc license", "isc", 0.8),
    ("cc by sa", "cc-by-sa", 0.8),
    ("cc by nc", "cc-by-nc", 0.8),
    ("cc by nd", "cc-by-nd", 0.8),
    ("creative commons attribution", "cc-by", 0.8),
    ("all rights reserved", "proprietary", 0.6),
]
TAG = "spdx license identifier"
TAG_WEIGHT, BASE_WEIGHT = 0.95, 0.8
ACCEPTED = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc-by-4.0", "cc0-1.0", "unlicense"})
EXCEPTIONS = frozenset({"classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception"})
#: Licence identifiers in use, lower-cased. What follows a tag and is none of them is no licence.
IDENTIFIERS = frozenset(
    """0bsd afl-2.1 afl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause
    bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6 cc0-1.0
    cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c cpl-1.0 curl ecl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2
    ftl hpnd icu ijg imagemagick intel isc json lppl-1.3c libpng libtiff mit mit-0 mit-cmu mpl-1.0 mpl-1.1 mpl-2.0
    mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 ncsa nist-pd odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 openssl osl-2.1
    osl-3.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sspl-1.0 tcl unicode-3.0 unicode-dfs-2016
    unlicense upl-1.0 vim w3c wtfpl x11 xnet zlib zpl-2.1""".split()
)
#: Families of identifiers by version, each with the endings it is used with.
FAMILIES = [
    (("gpl",), ("1.0", "2.0", "3.0"), ("", "-only", "-or-later")),
    (("lgpl",), ("2.0", "2.1", "3.0"), ("", "-only", "-or-later")),
    (("agpl",), ("1.0", "3.0"), ("", "-only", "-or-later")),
    (("gfdl",), ("1.1", "1.2", "1.3"), ("", "-only", "-or-later")),
    (("cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd"), ("1.0", "2.0", "2.5", "3.0", "4.0"), ("",)),
]
KNOWN = IDENTIFIERS | {f"{name}-{version}{end}" for names, versions, ends in FAMILIES for name in names for version in versions for end in ends}
#: Exceptions that may stand after WITH.
KNOWN_EXCEPTIONS = EXCEPTIONS | frozenset(
    """autoconf-exception-3.0 bison-exception-2.2 bootloader-exception font-exception-2.0 gcc-exception-2.0
    linux-syscall-note openssl-exception qt-gpl-exception-1.0 swift-exception wxwindows-exception-3.1""".split()
)
RANK = {"or": 1, "and": 2, "with": 3}


def tokens(expression: str) -> list[str]:
    return re.findall(r"[()]|[^\s()]+", expression.lower())


def to_postfix(expression: str) -> list[str] | None:
    """Postfix order by the shunting-yard method; None when the expression is not well formed."""
    out, stack, operand = [], [], False
    for t in tokens(expression):
        if t == "(":
            if operand:
                return None
            stack.append(t)
        elif t == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif t in RANK:
            if not operand:
                return None
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = False
        else:
            if operand or not re.fullmatch(r"[a-z0-9.:-]+\+?", t):
                return None
            out.append(t)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str, accepted: frozenset[str] = ACCEPTED, exceptions: frozenset[str] = EXCEPTIONS):
    """(licences, accepted?) of an expression, or None when it is not well formed.

    OR needs one accepted side, AND both; WITH applies a named exception to one licence, which is
    accepted when the licence or the exception is. "X+" stands for X.
    """
    postfix = to_postfix(expression)
    if postfix is None:
        return None
    stack: list[tuple[frozenset[str], bool, bool]] = []
    for t in postfix:
        if t not in RANK:
            name = t.removesuffix("+")
            stack.append((frozenset({name}), name in accepted or name in exceptions, True))
            continue
        (rights, right, last), (lefts, left, first) = stack.pop(), stack.pop()
        if t == "with":
            if not (first and last):
                return None
            stack.append((lefts, left or rights <= exceptions, False))
        else:
            stack.append((lefts | rights, left or right if t == "or" else left and right, False))
    names, verdict, _ = stack[0]
    return names, verdict


_PART = re.compile(r"[^\S\n\r]*([()]|[a-z0-9][a-z0-9.:+-]*)", re.I)
_OPENING = re.compile(r"[^\S\n\r]*[\"'`]?")


def leading_expression(text: str, at: int = 0, known: frozenset[str] = KNOWN, exceptions: frozenset[str] = KNOWN_EXCEPTIONS) -> str:
    """The longest well-formed expression of known identifiers from ``at`` on; else empty.

    It ends with the line, before other punctuation, before an unknown word and before whatever
    could not follow. A full stop, colon or hyphen at the end of a word is not part of it, and ends
    it. "LicenseRef-" and "DocumentRef-" names are known.
    """
    at = _OPENING.match(text, at).end()
    parts, best, opened = [], 0, 0
    while hit := _PART.match(text, at):
        at, raw = hit.end(), hit[1].lower()
        t = raw.rstrip(".:-")
        last = parts[-1] if parts else "("
        done = last not in RANK and last != "("  # an operand or a closing parenthesis stands before
        if t == "(":
            if done or last == "with":
                break
            opened += 1
        elif t == ")":
            if not done or not opened:
                break
            opened -= 1
        elif t in RANK:
            # One exception belongs to one licence.
            if not done or t == "with" and (last == ")" or len(parts) > 1 and parts[-2] == "with"):
                break
        else:
            name = t.removesuffix("+")
            own = name.startswith(("licenseref-", "documentref-")) or name in known
            if done or not (t in exceptions if last == "with" else own):
                break
        parts.append(t)
        if not opened and t not in RANK and t != "(":
            best = len(parts)
        if t != raw:
            break
    return " ".join(parts[:best])


def scan_licenses(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", accepted: frozenset[str] = ACCEPTED
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, notices, expressions.

    A-Z are lower-cased; words are runs of letters, digits and bytes from 0x80. ``notices`` lists
    every place of a phrase or tag as (label, word, length), ``expressions`` every expression after
    a tag as (text, licences, accepted); it holds known identifiers, those of ``accepted`` and
    "LicenseRef-" names, and whatever else follows a tag adds no label. ``score`` is 1 minus the
    product of 1 - weight over distinct labels. A null text is empty: no words, labels "", score 0,
    null first and last word. Repeated rows each have a row; other columns, whatever their names,
    are not looked at. An empty table gives no rows.
    """
    schema = schema_with(
        docs,
        {"doc_id": id_column},
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "notices array<struct<label: string, word: long, length: int>>, "
        "expressions array<struct<text: string, licences: array<string>, accepted: boolean>>",
    )
    phrases = {TAG: ("", TAG_WEIGHT, False)}
    phrases |= {p: (label, weight, False) for p, label, weight in NOTICES}
    phrases |= {p: (label, BASE_WEIGHT, True) for p, label in BASE.items()}
    classes = bytes(int(LOWER[c]) if ALNUM[c] else 32 for c in range(256))
    after_tag = re.compile(r"spdx-license-identifier\s*:", re.I)
    known = KNOWN | accepted
    names = [f.name for f in schema.fields]

    def find(tree, text: str) -> tuple:
        words = text.encode().translate(classes).split()
        line = " " + b" ".join(words).decode("latin-1") + " "
        notices, weight, base, starts, tagged = [], {}, set(), [], False
        spaces = upto = 0
        for end, (label, worth, is_base, length) in tree.iter(line):
            # Hits come by their ends, so every space is counted once.
            spaces += line.count(" ", upto, end + 1)
            upto = end + 1
            word = spaces - 1 - length
            if label:
                notices.append({"label": label, "word": word, "length": length})
                weight[label] = max(worth, weight.get(label, 0))
            else:
                tagged = True
                notices.append({"label": "spdx-tag", "word": word, "length": length})
            if is_base:
                base.add(label)
                starts.append(word)
        expressions = []
        if tagged:
            for hit in after_tag.finditer(text):
                said = leading_expression(text, hit.end(), known)
                found = evaluate(said, accepted) if said else None
                if found:
                    expressions.append({"text": said, "licences": sorted(found[0]), "accepted": found[1]})
                    weight |= {name: TAG_WEIGHT for name in found[0]}
        rest = 1.0
        for label in sorted(weight):
            rest *= 1 - weight[label]
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(weight)), round(1 - rest, 9), notices, expressions,
        )

    def work(tables):
        import ahocorasick

        tree = ahocorasick.Automaton()
        for phrase, (label, worth, is_base) in phrases.items():
            tree.add_word(f" {phrase} ", (label, worth, is_base, len(phrase.split())))
        tree.make_automaton()
        for part in tables:
            rows = [find(tree, t or "") for t in part["text"].to_pylist()]
            yield dict(zip(names, [part["doc_id"], *zip(*rows, strict=True)], strict=True))

    return map_rows(docs.selectExpr(f"`{id_column}` AS doc_id", f"`{text_column}` AS text"), schema, work)


@query("op3_licenses")
def op3(spark: SparkSession, directory: str) -> DataFrame:
    found = scan_licenses(table(spark, directory, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

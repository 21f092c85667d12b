"""Licence scans by sentence rules, in the manner of sentence-matching licence finders.

A text is cut into sentences: at their marks, at blank lines and around web addresses; wrapped lines and comment leaders are
spaces. A sentence is normalised (lower case, letters and digits only, without list numbers) and looked up among the
known licence sentences, whose identifier it becomes; sentences with a holder's name in them are looked up by what
stands around it. "Licensed under ..." sentences are references: their names are looked up in a table. SPDX tags are
read as expressions. A line may hold a known sentence without an end mark, so where a sentence is unknown its runs of
whole lines are looked up too.

A document's identifiers, in order, are then matched against ordered rules: a rule is a sequence of identifiers, rules
are tried from the first, and what a rule has used is not used again. Identifiers that no rule takes are reported as
unmatched. The tables are in license_sentences.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import license_sentences as known
from .shared import text_batches

#: Each known sentence holds one of these words or beginnings of words; a text without them has none.
HINTS = tuple(h.encode() for h in "licen permission permitted redistribut warrant liable liability endorse domain spdx waived unencumbered misrepresented altered anyone version acknowledgement authorization obtain under cc0".split())
_MARK = re.compile(r"(?<=[.!?;:])(?<!\b[Vv]\.)(?<!\bInc\.)(?<!\bLtd\.)(?<!\bCo\.)(?<!\bCorp\.)[\"')\]}”’]*\s+|\s*\n[^\S\n]*\n\s*|\s+(?=<?https?://)|(?<=\s)<?https?://\S+")
#: Runs of spaces are one from the start, so that no pattern walks over them again and again.
_SPACES = re.compile(r"[^\S\n]+")
#: A comment's leader at the start of a line; a line of a leader alone is blank.
_LEADER = re.compile(r"^[^\S\n]*(?:#+|//+|/?\*+/?|--+|;+|%+|>+|(?:dnl|REM)\b)", re.M)
_SPDX = re.compile(r"spdx-licen[sc]e-identifier:[^\S\n]*", re.I)
_SPDX_PART = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_NOISE = re.compile(r"[^a-z0-9]+")
_LIST = re.compile(r"^(?:[0-9]{1,2}|[a-hj-z]|i{1,3}|i?v|vi{0,3}) (?=[a-z])")
#: Words that a reference's subject must not have: they make it something else than a grant.
_REFERENCE = re.compile(r"^(?:except where otherwise noted )?(?:(?:this|the|our|all|these|it|its|content|contents|text|code) (?:(?!not |never |no |if |was |were |un)[a-z0-9]+ ){0,5}?)?(?:is |are |be )?(?:also |dual |free software |open source |freely )?(?:licensed|released|distributed|published|available|made available|provided|offered|shared) under (?:the terms (?:and conditions )?of )?(?:either |both |either of |one of )?(?:the |a |an )?(?P<name>.+?)(?: at your option)?$")
_DROP = frozenset("the a an license licenses version v international unported generic terms of".split())
#: Characters that the names of a reference take at most.
MOST_NAMED = 400
#: Lines that a sentence without end marks around it may take.
LINES = 12


def normalised(sentence: str) -> str:
    return _LIST.sub("", _NOISE.sub(" ", sentence.lower().replace("licence", "license")).strip())


@cache
def _tables() -> tuple[dict[str, str], dict[str, list[tuple[list[str], str]]], dict[str, str], dict[str, str], set[str]]:
    """(sentence -> identifier, first two words -> [(parts around stars, identifier)], name -> licence, lower-case SPDX
    name -> licence, the first two words of all)."""
    exact: dict[str, str] = {}
    holed: dict[str, list[tuple[list[str], str]]] = defaultdict(list)
    for identifier, text in known.SENTENCES + known.gnu_sentences():
        parts = [normalised(p) for p in text.split("*")]
        if len(parts) == 1:
            exact.setdefault(parts[0], identifier)
        else:
            holed[" ".join(parts[0].split()[:1])].append((parts, identifier))
    names = known.names()
    ids = {x.lower(): x for x in [*names.values(), *(r[0] for r in known.rules())]}
    firsts = {" ".join(s.split()[:2]) for s in exact}
    return exact, dict(holed), names, ids, firsts


def _fits(words: str, parts: list[str]) -> bool:
    """Do the words consist of the parts in their order, with 1 to 15 words for each star?"""
    at = len(parts[0])
    if not words.startswith(parts[0]):
        return False
    for k, part in enumerate(parts[1:], 1):
        stop = words.rfind(part) if k == len(parts) - 1 else words.find(f" {part} ", at)
        if stop < at or (k == len(parts) - 1 and stop + len(part) != len(words)) or not 1 <= len(words[at:stop].split()) <= 15:
            return False
        at = stop + len(part) + (1 if k < len(parts) - 1 else 0)
    return True


def _named(name: str) -> list[str] | None:
    """The licences that a reference names, or None if any is unknown."""
    if len(name) > MOST_NAMED:
        return None
    _, _, names, _, _ = _tables()
    later = re.search(r"(?: or (?:at your option )?(?:any )?(?:later|newer)(?: version)?| or above)$", name)
    core = name[: later.start()] if later else name
    core = " ".join(re.sub(r"^v(?=\d)", "", re.sub(r"(?<=gpl)v(?=\d)", "", w)) for w in core.split() if w not in _DROP)
    if core in names:
        return [f"{names[core]}-or-later" if later and "GPL" in names[core] else names[core]]
    for word in (" or ", " and "):
        if word in name:
            a, b = name.split(word, 1)
            if (x := _named(a)) and (y := _named(b)):
                return x + y
    return None


def identify(sentence: str) -> list[str]:
    """The identifiers of one normalised sentence: one if it is known, several for a reference to several licences."""
    exact, holed, *_ = _tables()
    if sentence in exact:
        return [exact[sentence]]
    for parts, identifier in holed.get(sentence.split(" ", 1)[0], ()):
        if _fits(sentence, parts):
            return [identifier]
    if " under " in sentence or sentence.startswith(("licensed ", "released ")):
        if m := _REFERENCE.match(sentence):
            return [f"ref {x}" for x in _named(m["name"]) or ()]
    return []


def spdx(text: str) -> str:
    """The licence expression at the start of text, names and operators in their usual case; empty if there is none."""
    *_, ids, _ = _tables()
    out: list[str] = []
    at, want, depth, good = 0, "name", 0, 0
    while m := _SPDX_PART.match(text, at):
        word = m[1]
        if want == "name" and word == "(":
            depth += 1
        elif want == "name" and word != ")" and word.upper() not in ("AND", "OR", "WITH"):
            word = word.rstrip(".")
            word = ids.get(word.lower(), word)
            want = "operator"
        elif want == "operator" and word == ")" and depth:
            depth -= 1
        elif want == "operator" and word.upper() in ("AND", "OR", "WITH"):
            word, want = word.upper(), "name"
        else:
            break
        out.append(word)
        at = m.end()
        if want == "operator" and not depth:
            good = len(out)
    return " ".join(out[:good]).replace("( ", "(").replace(" )", ")")


def _of_sentence(sentence: str) -> list[str]:
    low = sentence.lower().encode("utf-8", "replace")
    if not any(h in low for h in HINTS):
        return []
    if found := identify(normalised(sentence)):
        return found
    lines = [n for line in sentence.split("\n") if (n := normalised(line))]
    if len(lines) < 2:
        return []
    *_, firsts = _tables()
    _, holed, *_ = _tables()
    out, k = [], 0
    while k < len(lines):
        words = lines[k].split(" ")
        step = 1
        if " ".join(words[:2]) in firsts or words[0] in holed or " under " in f" {' '.join(lines[k : k + 2])} ":
            for stop in range(min(len(lines), k + LINES), k, -1):
                if found := identify(" ".join(lines[k:stop])):
                    out += found
                    step = stop - k
                    break
        k += step
    return out


def identifiers(text: str) -> list[str]:
    """The identifiers of a text's known sentences, in order."""
    text = _LEADER.sub("", _SPACES.sub(" ", text.replace("\r\n", "\n")))
    out: list[str] = []
    at = 0
    for m in _SPDX.finditer(text):
        for sentence in _MARK.split(text[at : m.start()]):
            out += _of_sentence(sentence)
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        if expression := spdx(text[m.end() : end]):
            out.append(f"spdx {expression}")
        at = max(at, end)
    for sentence in _MARK.split(text[at:]):
        out += _of_sentence(sentence)
    return out


@cache
def _rules() -> list[tuple[str, tuple[str, ...]]]:
    return known.rules()


def licences(found: list[str]) -> tuple[list[str], list[str]]:
    """(licences by rule order, then references and SPDX expressions; identifiers that no rule took)."""
    left, named = list(found), []
    there = set(left)
    for name, rule in _rules():
        while there.issuperset(rule):
            places, at = [], 0
            for want in rule:
                try:
                    at = left.index(want, at)
                except ValueError:
                    break
                places.append(at)
                at += 1
            if len(places) < len(rule):
                break
            named.append(name)
            for k in reversed(places):
                del left[k]
            there = set(left)
    simple = [x.split(" ", 1)[1] for x in left if x.startswith(("ref ", "spdx "))]
    return list(dict.fromkeys(named + simple)), [x for x in left if not x.startswith(("ref ", "spdx "))]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, sentences (known ones, in order), licences, unmatched, n_sentences; lists are
    joined by commas and empty if there are none.

    Null and empty texts have none. Very long texts are read whole, sentence by sentence. Rows may repeat, each gets
    its own result; an empty table gives an empty result; other columns are not read, whatever their names. Of several
    readings of a sentence the first in the table counts; of rules that fit, the first.
    """

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t in b.column(1):
                raw = t.as_buffer() if t.is_valid else None
                low = raw.to_pybytes().lower() if raw is not None else b""
                found = identifiers(raw.to_pybytes().decode("utf-8", "replace")) if any(h in low for h in HINTS) else []
                named, left = licences(found) if found else ([], [])
                for col, v in zip(out, (",".join(found), ",".join(named), ",".join(left), len(found)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in out[:3]), pa.array(out[3], pa.int64())], names=["_id", "sentences", "licences", "unmatched", "n_sentences"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(run, f"_id {kind}, sentences string, licences string, unmatched string, n_sentences bigint").withColumnRenamed("_id", id_col)

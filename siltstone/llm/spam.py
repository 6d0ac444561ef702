"""Keyword-stuffed pages, link lists and tag pages.

Method: every line is cut into units at the ends of sentences (a line that runs on in the
next is joined to it first), and each unit is reduced to a *shape*: the orders of
magnitude of its words, capitals, separators and links, whether it closes like a
sentence, and whether it is code.  The words of a page are grouped by shape.  A page
is flagged when few shapes that are neither sentences nor code hold most of its words.
Pages whose would-be sentences only repeat the same keywords are caught by the share
of different words in stretches of ``STRETCH`` words together with the phrases that
come twice within one unit.  The entries of a log repeat each other, but no entry repeats
itself; stuffed keywords do both.

Nothing here depends on the words of a language: a sentence is known by its length,
closing mark, case and separators.  Scripts without blanks are counted in pairs of
signs, those that close no sentence with a mark by their blanks.

Code (fenced or by its marks) is a shape of its own that speaks for a page as sentences
do; a frontmatter block counts neither way.

Scale: a page is judged from its own text alone, in the task that scans it; nothing
is shuffled, and memory is bounded by the longest text.

Defined results for odd input: null and empty texts and pages under ``least_words``
words are not spam; repeated documents are each reported; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import ne

import pyarrow as pa
from pyspark.sql import DataFrame

#: Words per stretch, and the share of different ones below which it only repeats keywords.
STRETCH, REPEATS_BELOW = 120, 0.4
#: Words of a unit looked at together, and the share of pairs of neighbours that come twice in them from which
#: a page repeats phrases within its units.
WINDOW, TWICE = 24, 0.045
#: Words that a unit without a closing mark needs to be a sentence.
LONG = 8

_SENTENCE_END = re.compile(r"(?<=[.!?؟۔।॥։።၊။។])[\"'”’)\]]*\s+(?=\S)|(?<=[。！？｡])[」』”’）]*\s*(?=\S)")
_TLD = "com|org|net|example|test|invalid|io|info|biz"
_LINK = re.compile(r"https?://\S+|www\.\S+|\[\[[^\]\n]*\]\]|\]\([^)\s]*\)|<a\s[^>]*>|#[^\W\d_][\w-]*")
_DOMAIN = re.compile(rf"[\w.-]*\.(?:{_TLD})\b(?:/\S*)?")
_LINK_HINT = re.compile(rf"://|www\.|\[\[|\]\(|<a |#|\.(?:{_TLD})\b")
_WORD = re.compile(r"[^\W\d_]+(?:['’̀-֑ͯ-ׇً-ْऀ-෿ั-๎ັ-ໍါ-ှា-៓][^\W\d_]*)*")
#: Han, kana and the scripts of South East Asia: no blanks between words.
_UNSPACED = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
#: Scripts that end a sentence with a blank.
_UNCLOSED = re.compile(r"[฀-໿]")
#: Marks between the parts of sentences too, and marks between entries.
_COMMA = re.compile(r"[,;、，；：]")
_SEPARATOR = re.compile(r"[|·•・／｜]|(?<!\S)[/>~=+](?!\S)| [-–—] ")
_ROW = re.compile(r"\s*\|.*\|\s*$")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_CODE = re.compile(
    r"\s*(?:\$\w+\s*(?:=|->|\[|;)|<\?php|//|/\*|\*/|#!|@\w+(?:\(.*\))?$|[})\]]+[;,]?$)"
    r"|\s*(?:import|from|use|namespace|package|using)\s+[\w.\\:/*]+(?:\s+(?:import|as)\s+[\w*., ]+)?;?\s*$"
    r"|\s*(?:def|class|function|fn|func|if|for|while|switch|return|const|let|var|public|private|protected|static|async|export)\b.*[(){}\[\]=].*$"
    r"|\s*[\w.\[\]$]+\s*[-+*/|&]?=\s*.*[;()\[\]{}\"'\d].*$|\s*[\w.$]+\(.*\)\s*;?$|.*[\w\])]\(.*\)\s*[;{]\s*$|.*(?:->|::|=>|\$\w|\{\{|\}\}).*[;{}),]\s*$"
)
_CODE_HINT = re.compile(r"[;{}()=$@\\]|->|::|^\s*(?:import|from|use|package|using|namespace)\s|//|/\*|#!")
_FRONTMATTER = re.compile(r"\A\s*---[ \t]*\r?\n(.*?\r?\n)??---[ \t]*(?:\r?\n|\Z)", re.S)
_CLOSED = re.compile(r"[.!?:。！？…؟۔।॥։።။។｡][\"'”’)\]*_`」』）]*\s*$")


def _tokens(text: str, unspaced: bool) -> list[str]:
    """The words of a text; runs of scripts without blanks as pairs of signs."""
    found = _WORD.findall(text)
    if not unspaced:
        return found
    out: list[str] = []
    for w in found:
        if _UNSPACED.search(w):
            out += [w[i : i + 2] for i in range(0, len(w), 2)]
        else:
            out.append(w)
    return out


def unit_shape(unit: str, unspaced: bool = False) -> tuple[tuple, int, bool, list[str]]:
    """(shape, words, whether it can be a sentence, its words in lower case) of one unit."""
    links, bare = 0, unit
    if _LINK_HINT.search(unit):
        bare, links = _LINK.subn(" ", unit)
        bare, more = _DOMAIN.subn(" ", bare)
        links += more
    tokens = _tokens(bare, unspaced)
    n = len(tokens)
    lower = [t.lower() for t in tokens] if n else tokens
    capitals = 0 if unit.isupper() else sum(map(ne, tokens, lower))
    separators, commas = len(_SEPARATOR.findall(bare)), len(_COMMA.findall(bare))
    closed = bool(_CLOSED.search(unit[-12:]))
    words = n + links * 2
    # what does not close needs more words and fewer marks, unless its script ends sentences with a blank
    if closed or (unspaced and _UNCLOSED.search(unit)):
        fits = n >= 3 and separators <= 2 + n / 12 and separators + commas <= 2 + n / 5
    else:
        fits = n >= LONG and separators + commas <= 1 + n / 12
    sentence = fits and links <= 1 + n / 8 and capitals <= 2 + n / 2
    shape = (words.bit_length(), (4 * capitals // n if n else 0), (separators + commas).bit_length(), links.bit_length(), closed)
    return shape, words, sentence, lower


def _units(text: str) -> Iterator[tuple[str, bool]]:
    """(unit, whether it is code) of a text, in order."""
    fenced, held = False, ""
    for line in _FRONTMATTER.sub("", text, count=1).splitlines():
        fence = _FENCE.match(line)
        code = not fence and (fenced or ("<a " not in line and _CODE_HINT.search(line) is not None and _CODE.match(line) is not None))
        if held:
            # a long line that closes nothing runs on where the next begins with a small letter or a sign without case
            first = line.lstrip("> \t")[:1]
            if not fence and not code and first.isalpha() and not first.isupper():
                line = f"{held} {line.lstrip('> ')}"
                held = ""
            else:
                yield from ((u, False) for u in _SENTENCE_END.split(held))
                held = ""
        if fence:
            fenced = not fenced
        elif code:
            yield line, True
        elif len(line) >= 30 and not _CLOSED.search(line[-12:]) and not _ROW.match(line) and "://" not in line and "[[" not in line:
            held = line
        elif _ROW.match(line):  # the cells of a table are its entries
            yield from ((u, False) for cell in line.strip().strip("|").split("|") for u in _SENTENCE_END.split(cell))
        elif line.strip():
            yield from ((u, False) for u in _SENTENCE_END.split(line))
    if held:
        yield from ((u, False) for u in _SENTENCE_END.split(held))


def _phrases_twice(units: list[list[str]]) -> float:
    """The share of pairs of neighbours that come again within the same stretch of a unit."""
    pairs = again = 0
    for tokens in units:
        for i in range(0, len(tokens), WINDOW):
            part = tokens[i : i + WINDOW]
            pairs += len(part) - 1
            again += len(part) - 1 - len(set(zip(part, part[1:], strict=False)))
    return again / pairs if pairs else 0.0


def judge(text: str | None, least_words: int = 8) -> tuple[bool, float, float, float, int]:
    """(spam, share of words in sentences and code, share held by the four largest other shapes, share that repeats keywords, words)."""
    if not text:
        return False, 0.0, 0.0, 0.0, 0
    unspaced = not text.isascii() and _UNSPACED.search(text) is not None
    other: Counter = Counter()
    in_sentences, spoken, units = 0, [], []
    for unit, code in _units(text):
        if not unit:
            continue
        if code:
            in_sentences += len(_WORD.findall(unit))
            continue
        shape, words, sentence, tokens = unit_shape(unit, unspaced)
        spoken += tokens
        units.append(tokens)
        if sentence:
            in_sentences += words
        elif words:
            other[shape] += words
    rest = sum(other.values())
    total = in_sentences + rest
    if total < least_words:
        return False, 0.0, 0.0, 0.0, total
    few = sum(n for _, n in other.most_common(4)) / rest if rest else 0.0
    repeated = 0
    for i in range(0, len(spoken), STRETCH):
        stretch = spoken[i : i + STRETCH]
        if len(stretch) >= WINDOW and len(set(stretch)) < REPEATS_BELOW * len(stretch):
            repeated += len(stretch)
    # the entries of a log repeat each other, but not themselves
    stuffed = repeated / total if repeated and _phrases_twice(units) >= TWICE else 0.0
    said = in_sentences / total
    spam = (rest >= least_words and said <= 0.4 and few >= 0.5 and (rest >= 24 or said == 0)) or stuffed > 0.5
    return spam, said, few, stuffed, total


_SCHEMA = "doc_id bigint, spam boolean, sentence_share double, shape_share double, repeat_share double, n_words bigint"


def judged_pages(documents: DataFrame, least_words: int = 8) -> DataFrame:
    """One row per document with a text: the verdict and the shares it rests on.  Needs doc_id and text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [judge(t, least_words) for t in batch.column(1).to_pylist()]
            spam, said, few, stuffed, total = zip(*verdicts, strict=True) if verdicts else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spam, pa.bool_()), pa.array(said, pa.float64()), pa.array(few, pa.float64()), pa.array(stuffed, pa.float64()), pa.array(total, pa.int64())],
                names=["doc_id", "spam", "sentence_share", "shape_share", "repeat_share", "n_words"],
            )

    return documents.select("doc_id", "text").where("text is not null").mapInArrow(scan, _SCHEMA)


def spam_pages(documents: DataFrame) -> DataFrame:
    """doc_id of the pages that are spam."""
    return judged_pages(documents).where("spam").select("doc_id")

"""Answers in model text: a label, a mark, a value.

An ``Answer`` says by which words an answer is announced, which marks stand between words and value, and what values there are; ``labelled`` finds the first one that is
announced, ``alone`` the first line that is nothing but a value, ``last_word`` a value that ends the text. What completions and baselines are
read for is a choice of these three in an order. All Columns; a text without an answer gives null."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dsl.values import strip

NUMBER = r"[-+]?\d+(?:\.\d+)?"


@dataclass(frozen=True)
class Answer:
    """``labels``: the ways to announce it, words divided by blanks ('=' where blanks have to be there, '~' where they may be); a label that ends in '()' may have a note
    in parentheses after it. ``values``: words, or none for a number."""

    labels: tuple[str, ...]
    values: tuple[str, ...] = ()
    marks: str = ":-"
    at_word: bool = True  # the label and the value begin and end at borders of words
    whole_line: bool = False  # label and value are all of a line

    def value(self) -> str:
        return "|".join(self.values) if self.values else NUMBER

    def pattern(self) -> str:
        announced = []
        for label in self.labels:
            words = label.removesuffix("()").replace("=", r"\s+").replace("~", r"\s*")
            announced.append(words + (r"(?:\s*\([^)]*\))?" if label.endswith("()") else ""))
        start, end = ("^", r"\s*$") if self.whole_line else (r"\b", r"\b") if self.at_word else ("", "")
        return rf"(?im){start}(?:{'|'.join(announced)})\s*[{re.escape(self.marks)}]\s*({self.value()}){end}"


# What answers are announced by, and what they are.
VERDICT = Answer(("final~verdict",), ("supported", "refuted"))
GRADE = Answer(("final~grade()",))
RESULT = Answer(("execution=result",), ("true", "false"), ":", whole_line=True)
FREE_VERDICT = Answer(("verdict",), ("supported", "refuted"), at_word=False)
FREE_RESULT = Answer(("result", "answer", "verdict"), ("true", "false"), at_word=False)
FREE_GRADE = Answer(("grade()", "score"), at_word=False)


def _first(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def labelled(text: Column, answer: Answer) -> Column:
    return _first(text, answer.pattern())


def alone(text: Column, answer: Answer, stops: str = "") -> Column:
    """The value of the first line that has only one, perhaps with one of these stops after it."""
    stop = rf"\s*[{stops}]?" if stops else ""
    return _first(text, rf"(?im)^\s*({answer.value()}){stop}\s*$")


def last_word(text: Column, answer: Answer) -> Column:
    word = F.lower(F.trim(F.element_at(F.split(strip(text), r"(?U)\s+"), -1), F.lit(".,!?")))
    return F.when(word.isin(*answer.values), word)


def first_number(text: Column, answer: Answer) -> Column:
    """The first number that is announced or stands alone on a line."""
    pattern = rf"{answer.pattern()}|^\s*({NUMBER})\s*$"
    at = lambda group: F.regexp_extract(text, pattern, group)
    return F.when(text.rlike(pattern), F.coalesce(F.nullif(at(1), F.lit("")), at(2)))

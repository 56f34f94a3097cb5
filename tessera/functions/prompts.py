"""Prompts as arrays of messages, written from the replies that they have to bring.

Each states the reply's fields first, then what a field may draw on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import messages


def _reply(task: str, **fields: str) -> str:
    """A prompt: the task, and a JSON object with these fields."""
    return " ".join([task, "Your reply is one JSON object, with nothing around it:", *(f"`{name}`: {meaning};" for name, meaning in fields.items())]).rstrip(";") + "."


ADJACENT_QUESTIONS = _reply("You are given a passage.", questions="a list of one, two or three texts, each a question to which the passage alone is a full answer and which a reader without the passage can understand; no two of a kind")
PAGE_QUESTIONS = _reply("You are given a page of a manual.", questions="a list of three to six texts, of one or two where the page has little to say; each is a question that somebody who needs the manual could have, that the page settles, and that no other item repeats")
ANSWERS = _reply("You are given a question and a context; nothing outside of the context is known.", answer="a text that settles the question, with the conditions and commands that the context names for it, or an empty text where the context doesn't settle it", evidence="a list of passages copied from the context on which the answer rests, empty if the answer is")
EVALUATION = _reply("You are given a question with its answer, and passages on which that answer rests.", question="a text that tests whether somebody has understood the same facts and that shares little wording with the given question", answer="a text that the passages support in full", evidence="a list of the passages used")
JUDGE = _reply("You are given a question, a reference and a candidate's answer to it.", correctness="1 (false) to 5 (agrees with the reference throughout)", completeness="1 (leaves out nearly all) to 5 (has all that the reference has)", unsupported_claims="how many statements of the candidate the reference doesn't bear out, from 0", rationale="a text of one or two sentences")


def _user(**parts: Column) -> Column:
    return F.concat_ws("\n\n", *(F.concat(F.lit(name.replace("_", " ").upper() + ":\n"), part) for name, part in parts.items()))


def question_messages(context: Column) -> Column:
    return messages(("system", F.lit(ADJACENT_QUESTIONS)), ("user", _user(context=context)))


def page_question_messages(context: Column) -> Column:
    return messages(("system", F.lit(PAGE_QUESTIONS)), ("user", _user(page_context=context)))


def answer_messages(question: Column, context: Column) -> Column:
    return messages(("system", F.lit(ANSWERS)), ("user", _user(question=question, context=context)))


def evaluation_messages(title: Column, question: Column, answer: Column, evidence: Column) -> Column:
    listed = F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("- "), e)), "\n\n")
    return messages(("system", F.lit(EVALUATION)), ("user", _user(source_title=title, training_question=question, training_answer=answer, evidence=listed)))


def judge_messages(question: Column, reference: Column, answer: Column) -> Column:
    return messages(("system", F.lit(JUDGE)), ("user", _user(question=question, reference=reference, candidate=answer)))

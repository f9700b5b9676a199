"""Calls of a model service from Arrow UDFs: retries, repair of JSON answers, and a shorter prompt as the last try."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.jsons import balanced_object
from ..functions.text import col

# fixed values: HTTP codes worth another try
AGAIN = (408, 429, 500, 502, 503, 504)


def retrying(call: Callable, retries: int = 3, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` tried again after transport errors and the codes in AGAIN (``code`` of the error); waits double."""

    def run(*args):
        for n in range(retries + 1):
            try:
                return call(*args)
            except Exception as e:
                code = getattr(e, "code", None)
                passing = isinstance(e, (ConnectionError, TimeoutError)) or code in AGAIN
                if n == retries or not passing:
                    raise
                sleep(backoff * 2**n)

    return run


def json_answer(call: Callable[[str], str], full: str, compact: str | None, issues: Callable[[dict], list[str]], repairs: int = 2) -> str | None:
    """The first answer without issues, as JSON: the full prompt, then ``repairs`` prompts that say what is wrong, then the
    compact prompt; None where none is good or the service fails for good."""

    def ask(prompt: str) -> tuple[dict | None, list[str], str]:
        try:
            said = call(prompt) or ""
        except Exception as e:  # the message falls back, the job goes on
            return None, [f"{type(e).__name__}: no answer"], ""
        found = balanced_object(said)
        answer = json.loads(found) if found else None
        return answer, ["no JSON object"] if answer is None else issues(answer), said

    answer, wrong, said = ask(full)
    for _ in range(repairs):
        if not wrong:
            break
        answer, wrong, said = ask(f"{full}\n\nThe last answer was not valid ({'; '.join(wrong)}):\n{said[:2000]}\nAnswer with the corrected JSON object alone.")
    if wrong and compact:
        answer, wrong, _ = ask(compact)
    return None if wrong else json.dumps(answer, ensure_ascii=False, sort_keys=True)


def json_answers(call: Callable[[str], str], issues: Callable[[dict], list[str]], repairs: int = 2, retries: int = 3) -> Callable[[Column, Column], Column]:
    """(full prompt, compact prompt) columns to JSON or null."""

    def run(full: pd.Series, compact: pd.Series) -> pd.Series:
        service = retrying(call, retries)
        return pd.Series([json_answer(service, f or "", c, issues, repairs) for f, c in zip(full, compact)], dtype="object")

    return lambda full, compact: F.pandas_udf(run, "string")(col(full), col(compact))


def missing_text(*names: str) -> Callable[[dict], list[str]]:
    """A contract: the names must have a text that isn't blank."""
    return lambda answer: [f"{n} must be a non-empty string" for n in names if not (isinstance(answer.get(n), str) and answer[n].strip())]

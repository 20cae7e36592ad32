"""Calls of language models for batches of prompts."""

from __future__ import annotations

from typing import Protocol


class Model(Protocol):
    """Anything that can be pickled and answers prompts."""

    def answer(self, prompts: list[str]) -> list[str]: ...


def answered(model: Model, prompts: list[str]) -> list[str | Exception]:
    """The answer to each prompt, or the error that it alone gives: a batch that fails, or whose answers don't match its
    prompts in number, is asked again in halves, so others lose nothing by a prompt that can't be answered. Without
    prompts nothing is asked."""
    if not prompts:
        return []
    try:
        answers = list(model.answer(prompts))
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
        return answers
    except Exception as error:  # whatever a provider raises
        if len(prompts) == 1:
            return [error]
    half = len(prompts) // 2
    return answered(model, prompts[:half]) + answered(model, prompts[half:])

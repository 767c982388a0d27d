"""Reply providers: a protocol, offline ones, and HTTP ones that load their client where they run."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Provider(Protocol):
    def generate_reply(self, question: str, n: int = 1, max_tokens: int = 1024, temperature: float = 0.0, system_msg: str | None = None) -> list[str]: ...


class Rejected(Exception):
    """A request that no retry can mend."""


def check(n: int, temperature: float) -> None:
    if temperature == 0.0 and n != 1:
        raise ValueError("n must be 1 at temperature 0")


# What a blocked reply's error says, and the seconds to wait after a rate limit, a lost connection and anything else.
BLOCKED = "Output blocked by content filtering policy"
WAITS = (("RateLimit", 10.0), ("Connection", 5.0), ("InternalServer", 5.0), ("", 1.0))


def retried(call: Callable[[], object], attempts: int = 6, wait: float | None = None):
    """call() again after failures, with the wait of their kind; bounded, unlike a client that must not lose its place. A reply that a content filter blocks is Rejected at once."""
    for k in range(attempts):
        try:
            return call()
        except Rejected:
            raise
        except Exception as e:
            if BLOCKED in str(getattr(e, "body", "")) or BLOCKED in str(e):
                raise Rejected(BLOCKED) from e
            if k == attempts - 1:
                raise
            time.sleep(next(s for kind, s in WAITS if kind in type(e).__name__) if wait is None else wait)


def stop_sequence(tokenizer) -> str:
    """What the chat template of a tokenizer writes after an assistant's message."""
    mark = "\x00end-of-reply\x00"
    return tokenizer.apply_chat_template([{"role": "user", "content": ""}, {"role": "assistant", "content": mark}], tokenize=False).rpartition(mark)[2]


def model_stops(model: str) -> list[str]:
    """The stop sequences of a model whose tokenizer can be loaded here, none otherwise."""
    try:
        from transformers import AutoTokenizer

        tokenizer = AutoTokenizer.from_pretrained(model)
        return [x for x in [stop_sequence(tokenizer)] if x] if getattr(tokenizer, "chat_template", None) else []
    except Exception:  # no such package, model or network
        return []


class Echo:
    """Answers with the question: for tests and dry runs."""

    def generate_reply(self, question, n=1, max_tokens=1024, temperature=0.0, system_msg=None):
        check(n, temperature)
        return [question] * n


class Lookup:
    """Answers from a table of questions; others get an empty reply."""

    def __init__(self, replies: dict[str, str]):
        self.replies = replies

    def generate_reply(self, question, n=1, max_tokens=1024, temperature=0.0, system_msg=None):
        check(n, temperature)
        return [self.replies.get(question, "")] * n


class OpenAI:
    def __init__(self, model: str, base_url: str | None = None):
        import openai

        self.stop = model_stops(model)
        self.model, self.client = model, openai.OpenAI(api_key=os.getenv("OPENAI_API_KEY", "none"), base_url=base_url, timeout=100)

    def generate_reply(self, question, n=1, max_tokens=1024, temperature=0.0, system_msg=None):
        check(n, temperature)
        messages = [{"role": "system", "content": system_msg}] * bool(system_msg) + [{"role": "user", "content": question}]
        got = retried(lambda: self.client.chat.completions.create(model=self.model, messages=messages, n=n, max_tokens=max_tokens, temperature=temperature, **({"stop": self.stop} if self.stop else {})))
        return [x.message.content for x in got.choices]


class Anthropic:
    def __init__(self, model: str):
        import anthropic

        self.model, self.client = model, anthropic.Anthropic(api_key=os.environ["ANTHROPIC_KEY"], timeout=100)

    def generate_reply(self, question, n=1, max_tokens=1024, temperature=0.0, system_msg=None):
        check(n, temperature)
        more = {"system": system_msg} if system_msg else {}
        ask = lambda: self.client.messages.create(model=self.model, messages=[{"role": "user", "content": question}], max_tokens=max_tokens, temperature=temperature, **more)
        return [retried(ask).content[0].text for _ in range(n)]


class Google:
    def __init__(self, model: str):
        import google.generativeai as genai

        genai.configure(api_key=os.environ["GOOGLE_API_KEY"])
        self.client = genai.GenerativeModel(model)

    def generate_reply(self, question, n=1, max_tokens=1024, temperature=0.0, system_msg=None):
        check(n, temperature)
        text = f"{system_msg}\n{question}" if system_msg else question
        got = retried(lambda: self.client.generate_content(text, generation_config={"candidate_count": n, "max_output_tokens": max_tokens, "temperature": temperature}))
        out = [c.content.parts[0].text if c.content.parts else "" for c in got.candidates]
        return out + [""] * (n - len(out))


class Local:
    """vllm or transformers on the executors' own accelerators; needs their packages there."""

    def __init__(self, model: str, context_size: int = 16384, tensor_parallel_size: int = 1):
        import vllm

        self.params, self.engine = vllm.SamplingParams, vllm.LLM(model, max_model_len=int(1.5 * context_size), tensor_parallel_size=tensor_parallel_size)

    def generate_reply(self, question, n=1, max_tokens=1024, temperature=0.0, system_msg=None):
        check(n, temperature)
        messages = [{"role": "system", "content": system_msg}] * bool(system_msg) + [{"role": "user", "content": question}]
        return [x.text for x in self.engine.chat(messages, self.params(n=n, max_tokens=max_tokens, temperature=temperature))[0].outputs]


class Transformers:
    def __init__(self, model: str, trust_remote_code: bool = False, attn_implementation: str | None = None):
        import transformers

        self.stop = model_stops(model)
        more = {"attn_implementation": attn_implementation} if attn_implementation else {}
        self.pipe = transformers.pipeline("text-generation", model, trust_remote_code=trust_remote_code, device_map="auto", model_kwargs=more)

    def generate_reply(self, question, n=1, max_tokens=1024, temperature=0.0, system_msg=None):
        check(n, temperature)
        messages = [{"role": "system", "content": system_msg}] * bool(system_msg) + [{"role": "user", "content": question}]
        draw = {"do_sample": True, "temperature": temperature} if temperature else {"do_sample": False}
        return [x["generated_text"][-1]["content"] for x in self.pipe(messages, max_new_tokens=max_tokens, num_return_sequences=n, **draw, **({"stop_strings": self.stop, "tokenizer": self.pipe.tokenizer} if self.stop else {}))]


BACKENDS = {"openai": OpenAI, "vllm": Local, "anthropic": Anthropic, "hf": Transformers, "google": Google, "echo": Echo, "lookup": Lookup}


def backend(name: str | None, base_url: str | None = None):
    name = name or ("openai" if base_url else "vllm")
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name}; one of {sorted(BACKENDS)}")
    return BACKENDS[name]


def run_provider(tasks: DataFrame, make: Callable[[], Provider], max_tokens: int = 1024, system_msg: str | None = None, question: str = "prompt", temperature: float = 0.0) -> DataFrame:
    """tasks with output: array of replies to the question column. make() runs once a task partition; a rerun task asks again, so write by key."""
    from pyspark.sql import types as T

    schema = T.StructType([*tasks.schema.fields, T.StructField("output", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for pdf in batches:
            yield pdf.assign(output=[provider.generate_reply(q, max_tokens=max_tokens, temperature=temperature, system_msg=system_msg or None) for q in pdf[question]])

    return tasks.mapInPandas(run, schema)

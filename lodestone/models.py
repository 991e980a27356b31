"""Text generation behind an interface: one client a task, a deterministic stub by default."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from lodestone.functions.urls import normalize_api_base

OPENAI_NAMES = {"openai", "openai_compatible", "api", "llama_server", "ollama", "lmstudio"}


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class Extractive:
    """The first sentences of the prompt's sources; needs no model and always says the same."""

    def __init__(self, sentences: int = 2):
        self.sentences = sentences

    def generate(self, prompt: str) -> str:
        body = prompt.rsplit("\n\n", 1)[-1]
        return " ".join(re.split(r"(?<=[。！？!?.])\s+", body.strip())[: self.sentences])


def messages(prompt: str, system: str = "") -> list[dict[str, str]]:
    """A chat of one turn; a blank system prompt is left out."""
    return [{"role": role, "content": text} for role, text in (("system", system), ("user", prompt)) if text or role == "user"]


class OpenAICompatible:
    def __init__(self, base: str, model: str, key: str = "", max_tokens: int = 256, timeout: float = 120.0, transport: Callable | None = None, system: str = ""):
        self.url, self.model, self.key, self.max_tokens, self.timeout = normalize_api_base(base), model, key, max_tokens, timeout
        self.system = system
        self.transport = transport or self._post

    def _post(self, body: dict) -> dict:
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
            return json.load(answer)

    def generate(self, prompt: str) -> str:
        answer = self.transport({"model": self.model, "messages": messages(prompt, self.system), "max_tokens": self.max_tokens, "temperature": 0})
        return answer["choices"][0]["message"]["content"].strip()


class LocalModel:
    """A causal model of a local folder through the optional ``transformers`` package, loaded once a task.

    Code that comes with a model is not run.
    """

    def __init__(self, path: str, max_tokens: int = 256, system: str = "", load: Callable | None = None):
        self.max_tokens, self.system = max_tokens, system
        self.tokenizer, self.model = (load or self._load)(path)

    @staticmethod
    def _load(path: str):
        try:
            from transformers import AutoModelForCausalLM, AutoTokenizer
        except ModuleNotFoundError as e:
            raise RuntimeError("a local model needs the transformers package") from e
        return AutoTokenizer.from_pretrained(path), AutoModelForCausalLM.from_pretrained(path).eval()

    def chat(self, prompt: str) -> str:
        """The prompt in the model's chat template, without a thinking part where the template has that switch."""
        form = {"tokenize": False, "add_generation_prompt": True}
        try:
            return self.tokenizer.apply_chat_template(messages(prompt, self.system), enable_thinking=False, **form)
        except TypeError:
            return self.tokenizer.apply_chat_template(messages(prompt, self.system), **form)

    def generate(self, prompt: str) -> str:
        asked = self.tokenizer(self.chat(prompt), return_tensors="pt")
        told = self.model.generate(**asked, max_new_tokens=self.max_tokens, do_sample=False)
        return self.tokenizer.decode(told[0][len(asked["input_ids"][0]) :], skip_special_tokens=True).strip()


def _status(url: str, timeout: float) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
            return answer.status, ""
    except urllib.error.HTTPError as e:
        return e.code, e.read(800).decode("utf-8", "replace")[:200]


def ping(base: str, timeout: float = 3.0, get: Callable[[str, float], tuple[int, str]] = _status) -> dict:
    """Whether an endpoint lists its models; advisory, as some servers have no such list."""
    url = normalize_api_base(base)
    if not url:
        return {"ok": False, "error": "LLM_API_BASE is empty"}
    listing = url.replace("/chat/completions", "/models")
    try:
        status, text = get(listing, timeout)
    except Exception as e:  # noqa: BLE001
        return {"ok": False, "endpoint": url, "error": str(e)[:200]}
    if status < 400:
        return {"ok": True, "endpoint": url, "models_endpoint": listing}
    return {"ok": False, "endpoint": url, "status_code": status, "warning": text}


def is_openai_compatible(name: str | None) -> bool:
    return (name or "").strip().lower() in OPENAI_NAMES


def generate(prompts: DataFrame, make: Callable[[], Generator] = Extractive) -> DataFrame:
    """(qid, answer) of (qid, prompt); an error gives an empty answer, which the guards turn down."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            answers = []
            for p in f["prompt"]:
                try:
                    answers.append(model.generate(p or ""))
                except Exception:  # noqa: BLE001
                    answers.append("")
            yield pd.DataFrame({"qid": f["qid"], "answer": answers})

    return prompts.select("qid", "prompt").mapInPandas(run, "qid long, answer string")

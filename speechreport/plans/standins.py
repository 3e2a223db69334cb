"""Stand-ins for engines: fixed rules over texts, so that results are known. They recognize nothing."""

from __future__ import annotations

import json

from speechreport.operators.prompts import ENGINE_LABEL


class EchoSpeech:
    """Takes a text for a recording and gives it back, edited by a rule."""

    def __init__(self, old: str = "", new: str = ""):
        self.old, self.new = old, new

    def transcribe(self, audio: object, rate: int, language: str | None, access: dict) -> str:
        text = audio if isinstance(audio, str) else f"{len(audio)} samples"
        return text.replace(self.old, self.new) if self.old else text


class FirstSection:
    """Answers with the first transcript of the prompt as a fenced report, and a note of its length."""

    def chat(self, messages: list, params: object, access: dict) -> str:
        user = next(m["content"] for m in messages if m["role"] == "user")
        _, _, body = user.partition(ENGINE_LABEL[1])
        first = body.split("\n\n" + ENGINE_LABEL[0])[0]
        report = {"raw_transcript": first, "corrected_transcript": first.strip(), "final_text": None, "discrepancies_found": [], "notes": str(len(first))}
        return f"Here it is:\n```json\n{json.dumps(report, ensure_ascii=False)}\n```\nDone."

    def chat_audio(self, messages: list, audio: object, params: object, access: dict) -> str:
        heard = audio if isinstance(audio, str) else f"{len(audio)} samples"
        return json.dumps({"raw_transcript": heard, "notes": next(m["content"] for m in messages if m["role"] == "user")})


class Recounter:
    """Answers with how much was said so far, its own replies included, and the first letters of the last message."""

    def chat(self, messages: list, params: object, access: dict) -> str:
        return f"{len(messages)} messages, {sum(len(m['content']) for m in messages)} letters: {messages[-1]['content'][:20]}"


STT = {"seamless": EchoSpeech, "whisper": lambda: EchoSpeech(" the ", " zqx "), "mms-all": lambda: EchoSpeech(" of ", " qzf ")}
LLM = {"aya-expanse-8b": FirstSection, "gemma-4-e4b": FirstSection}
CHAT = {"recounter": Recounter, "other": Recounter}

"""Result-defining constants, gathered in one frozen settings object."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Fixed value: the prompt wording is part of the result.
PROMPT_TEMPLATE = """参考信息：
{context}
---
我的问题或指令：
{question}
---
请根据上述参考信息回答我的问题或回复我的指令。前面的参考信息可能有用，也可能没用，你需要从我给出的参考信息中选出与我的问题最相关的那些，来为你的回答提供依据。回答一定要忠于原文，简洁但不丢信息，不要胡乱编造。我的问题或指令是什么语种，你就用什么语种回复,
你的回复："""

# Labels that appear in results.
EMBED_VERSION = "openai_compatible_v1"
DEFAULT_EMBED_VERSION = "v2"
SYSTEM_PROMPT = "You are a helpful assistant."
TITLE_CATEGORY = "cn_Title"
SERVICES = ("llm", "embedding", "rerank", "ocr", "faiss", "sqlite", "gpu")
TABULAR_EXTENSIONS = ("csv", "xlsx")
FILE_STATUSES = ("green", "yellow", "red", "gray")


@dataclass(frozen=True)
class Settings:
    """Defaults of every operator; pass a changed copy to tune a job."""

    sentence_chars: int = 100
    chunk_tokens: int = 400
    chunk_overlap_tokens: int = 200
    context_chars: int = 800
    context_window: int = 200
    top_k: int = 100
    max_distance: float = 1.1
    no_hit_distance: float = math.sqrt(2)
    min_mean_score: float = 0.65
    title_enhance: bool = False
    embedding_dim: int = 1024
    rerank_query_chars: int = 300
    token_window: int = 8192
    offcut_tokens: int = 50
    trim_chars: int = 50
    prompt_template: str = PROMPT_TEMPLATE
    system_prompt: str = SYSTEM_PROMPT
    embed_batch: int = 16
    embed_attempts: int = 3
    embed_delay_seconds: float = 1.0
    search_limit: int = 50
    probe_seconds: int = 60

    @property
    def answer_tokens(self) -> int:
        """Tokens reserved for the answer: half of the window."""
        return self.token_window // 2

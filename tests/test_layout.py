"""Nothing outside the llm subpackage imports it, but for the guarded import of the entry module."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_llm_is_separate():
    for p in (ROOT / "strataq").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"strataq\.llm|from strataq import llm", p.read_text()), p

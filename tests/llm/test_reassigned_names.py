"""op2: names that are assigned more than once."""

from __future__ import annotations

import pytest

from scriptorium.llm import secrets


def flows(text: str) -> list[str]:
    return [text[s.start : s.end] for s in secrets.flow_spans(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('key = ""\nkey = "Zx81-kQp2-Lm7v"\npassword = key\n', ["Zx81-kQp2-Lm7v"]),
        ('v = "aB3-first-x9Q"\npassword = v\nv = "cD4-later-y8R"\ntoken = v\n', ["aB3-first-x9Q", "cD4-later-y8R"]),
        ('v = "Zx81-kQp2"\nv = v + "-Lm7vQQ1z"\npassword = v\n', ["Zx81-kQp2", "-Lm7vQQ1z"]),
        ('password = v\nv = "Zx81-kQp2-Lm7v"\n', ["Zx81-kQp2-Lm7v"]),
        ("password = password\n", []),
    ],
)
def test_names_that_are_assigned_again(text, want):
    assert flows(text) == want

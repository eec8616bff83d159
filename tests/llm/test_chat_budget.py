"""Long conversations render whole; runaway templates are stopped."""

import pytest

from quillon.llm import chat


def test_long_conversation():
    n = 250_000
    text, marks = chat.Template(chat.CHATML).render({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "bc"}] * (n // 2)})
    one = "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nbc<|im_end|>\n"
    assert text == one * (n // 2)
    assert len(marks) == n // 2 and text[slice(*marks[-1])] == "bc<|im_end|>"


def test_runaway_template():
    nested = "{% for a in messages %}{% for b in messages %}{% for c in messages %}x{% endfor %}{% endfor %}{% endfor %}"
    with pytest.raises(chat.TemplateError):
        chat.Template(nested).render({"messages": [{"role": "user", "content": ""}] * 400})

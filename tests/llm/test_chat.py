"""The template compiler: parsing, folding, the sandbox, and conversations with odd rows."""

import random

import pytest

from quillon.llm import chat


def render(source, **names):
    return chat.Template(source).render(names)[0]


@pytest.mark.parametrize("source,want", [
    ("a{# x #}b {%- if 1 < 2 -%} c {%- endif %}", "abc"),
    ("{% for x in [1, 2, 3] %}{{ loop.index }}{% if not loop.last %},{% endif %}{% else %}none{% endfor %}", "1,2,3"),
    ("{% for x in [] %}a{% else %}none{% endfor %}", "none"),
    ("{{ 1 + 2 * 3 - -1 }} {{ 7 // 2 }} {{ 7 % 4 }} {{ 'a' ~ 1 ~ none }}", "8 3 3 a1"),
    ("{{ ('b' if x is defined else 'c') }}{{ x.y.z }}{{ x|default('d') }}", "cd"),
    ("{% set a = 'x' %}{{ a + 'y' }}{{ 'abc'[1:] }}{{ 'abc'[-1] }}{{ [1, 2][0] }}", "xybcc1"),
    ("{{ 'a' in 'cat' and not 'x' in 'cat' }}{{ 2 is even }}{{ 3 is not odd }}", "TrueTrueFalse"),
    ("{{ ' a '|trim|upper }}{{ ['b', 'c']|join('-') }}{{ 'aXa'|replace('a', 'bb') }}{{ 'q\\n\\'' }}", "Ab-cbbXbbq\n'"),
    ("{{ '%}' }}{% if 'a' == \"a\" %}y{% elif z %}n{% else %}m{% endif %}", "%}y"),
])
def test_language(source, want):
    assert render(source) == want


@pytest.mark.parametrize("source", ["{{ x", "{% if x %}", "{% for x %}{% endfor %}", "{{ a b }}", "{{ x.__class__ }}", "{{ _x }}", "{{ x['__a'] }}", "{{ open('a') }}", "{{ x.f() }}", "{{ 'a' * 9 }}", "{{ 'a' % 1 }}", "{{ x|nothing }}", "{{ x is nothing }}", "{% do x %}", "{{ raise_exception('no') }}", "{{ " + "(" * 5000 + "1" + ")" * 5000 + " }}"])
def test_refused(source):
    with pytest.raises(chat.TemplateError):
        render(source, x={"a": 1})


def test_folding_changes_nothing():
    rng = random.Random(7)

    def expression(depth):
        if not depth:
            return rng.choice(["1", "2", "'a'", "'bc'", "x", "y", "true", "none", "x.k"])
        a, b = expression(depth - 1), expression(depth - 1)
        return rng.choice([f"({a} ~ {b})", f"({a} == {b})", f"({a} and {b})", f"({a} or {b})", f"(not {a})", f"({a} if {b} else {a})", f"({a}|string|upper)", f"({a} is defined)", f"([{a}, {b}][0])", f"(({a}|string)[1:])"])

    def block(depth):
        if not depth:
            return rng.choice(["t", "{{ " + expression(2) + " }}"])
        e, a, b = expression(2), block(depth - 1), block(depth - 1)
        return rng.choice([a + b, f"{{% if {e} %}}{a}{{% else %}}{b}{{% endif %}}", f"{{% for i in [1, {e}] %}}{a}{{{{ i }}}}{{% endfor %}}", f"{{% set y = {e} %}}{a}", f"{{% generation %}}{a}{{% endgeneration %}}{b}"])

    for _ in range(300):
        source = block(3)
        names = {"x": {"k": "v"}, "y": 3}
        plain = chat._Run(dict(names))
        chat._closure(chat.parse(source))(plain)
        assert chat.Template(source).render(names) == ("".join(plain.out), plain.marks)
    assert chat.Template("{{ 1 + 1 }}{% if 2 > 3 %}a{% endif %}b").tree == chat.Node("block", (chat.Node("text", ("2b",)),))


@pytest.mark.parametrize("source", ["{% set a = 'xy' %}" + "{% set a = a + a %}" * 40 + "{{ a }}", "{{ range(1000000000)|list }}", "{{ ('a' ~ 'b')|replace('', m[0].content) }}" * 30, "{% set a = m[0].content %}" + "{% set a = [a, a, a, a, a, a, a, a]|join(a) %}" * 12])
def test_memory_is_bounded(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source).render({"m": [{"content": "z" * 100_000}]})


def test_conversations(spark):
    rows = [
        (1, 2, "assistant", "b", "x"), (1, 1, "user", "a", "x"), (1, None, "system", "s", "x"), (1, 2, "assistant", "a", "x"), (1, 2, "assistant", "a", "x"),
        (None, 1, None, "t", "x"), (None, 1, "user", None, "x"), (2, 1, "user", "", "x"), (3, 1, "user", "é" * 200_000, "x"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, messages string")
    got = {r["conv_id"]: r for r in chat.format_conversations(turns).collect()}
    part = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got[1]["text"] == part("system", "s") + part("user", "a") + part("assistant", "a") * 2 + part("assistant", "b") and got[1]["n_turns"] == 5
    assert [got[1]["text"][slice(*map(int, s.split(":")))] for s in got[1]["spans"].split(",")] == ["a<|im_end|>"] * 2 + ["b<|im_end|>"]
    assert got[None]["text"] == part("", "t") + part("user", "") and got[2]["spans"] == "" and len(got[3]["text"]) > 200_000
    assert chat.format_conversations(turns.limit(0)).count() == 0
    bad = chat.format_conversations(turns, "{% for m in messages %}{{ m.content|int }}{% endfor %}")
    assert {r["conv_id"] for r in bad.collect() if r["error"] and r["text"] is None} == {1, None, 3}

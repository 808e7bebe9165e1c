import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqmill.llm import chat

PARTS = st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "/INST]", "s>", "a", "é", "\n", "[INS\\T]", "<\\s>"])
TEXTS = st.one_of(st.lists(PARTS, max_size=12).map("".join), st.text(max_size=20))
ROLES = st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXTS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), max_size=6))
def test_round_trip_and_mask(turns):
    text, spans = chat.compiled(chat.TEMPLATE)([{"role": r, "text": t} for r, t in turns])
    assert chat.read_turns(text) == turns
    assert chat.loss_text(text, spans) == "".join(t for r, t in turns if r == "assistant")


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_no_text_forges_a_control(text):
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)
    assert chat.unescape(chat.escape(text)) == text


@pytest.mark.parametrize(
    ("template", "want"),
    [
        ("{{ 'a' ~ 1 + 2 }}", "a12"),
        ("{{ 1 + 2 }}", "3"),
        ("{% if true and not false %}x{% else %}y{% endif %}", "x"),
        ("{% for m in messages %}{{ loop.index }}{{ m['role'] }}{% if not loop.last %},{% endif %}{% endfor %}", "1user,2assistant"),
        ("{{ messages[0].text | trim | upper }}", "HI"),
        ("{{ missing | default('none') }}{# gone #}", "none"),
        ("{% set x = messages | length %}{{ x if x > 1 else 'few' }}", "2"),
        ("a {{- 'b' -}} c", "abc"),
        ("{{ '<s>' | raw }}{{ '<s>' }}", "<s><\\s>"),
        ("{{ messages.__class__ }}{{ messages[0].__class__ }}", ""),
        ("{{ 'x' in ['x'] }}", None),
        ("{{ 'a' in 'abc' }}", "True"),
        ("{{ 'a' < 1 }}{{ none >= 0 }}{{ 1 < 2 }}{{ 'a' < 'b' }}", "FalseFalseTrueTrue"),
        ("{{ 1 in 'abc' }}{{ messages in messages[0] }}{{ 'role' in messages[0] }}", "FalseFalseTrue"),
        ("{{ messages[0][messages] }}{{ messages[99] }}{{ not not not true }}", "False"),
    ],
)
def test_language(template, want):
    run = lambda: chat.compiled(template)([{"role": "user", "text": " hi "}, {"role": "assistant", "text": "yo"}])[0]
    if want is None:
        with pytest.raises(chat.TemplateError):
            run()
    else:
        assert run() == want


@pytest.mark.parametrize("bad", ["{% if x %}", "{{ }}", "{{ f(1) }}", "{% import os %}", "{{ a | nofilter }}", "{% for x %}{% endfor %}", "{{ 'a' 'b' }}", "{{ 'a' | trim('x') }}", "{{ 1 | default(1, 2) }}", "{{ " + "9" * 5000 + " }}",
    "{% if x %}" * 2000 + "{% endif %}" * 2000, "{{ " + "(" * 2000 + "1" + ")" * 2000 + " }}", "{{ " + "1+" * 5000 + "1 }}", "{{ " + "-" * 5000 + "1 }}", "{{ a" + ".b" * 5000 + " }}", "{% for 1 in x %}{% endfor %}", "{% set 'a' = 1 %}"])
def test_errors(bad):
    with pytest.raises(chat.TemplateError):
        chat.compiled(bad)


TOKENS = st.sampled_from(["{{", "}}", "{%", "%}", "{#", "#}", "if", "elif", "else", "endif", "for", "endfor", "x", "in", "messages", "set", "=", "==", "<", "+", "~", "|", "trim", "default", "(", ")", "[", "]", ".", ",", "'a'", "1", "-", "not", "and", "generation", "endgeneration", "raw", "\n"])


@settings(max_examples=2000, deadline=None)
@given(st.lists(TOKENS, max_size=25).map(" ".join))
def test_any_text_compiles_and_renders_or_is_a_template_error(template):
    try:
        run = chat.compiled(template)
    except chat.TemplateError:
        return
    text, spans = run([{"role": "user", "text": "hi"}, {"role": "assistant", "text": None}])
    assert all(0 <= a <= b <= len(text) for a, b in spans)


def test_marks_within_marks_count_once():
    text, spans = chat.compiled("{% generation %}a{% generation %}b{% endgeneration %}c{% endgeneration %}d{% generation %}e{% endgeneration %}")([])
    assert text == "abcde" and chat.loss_text(text, spans) == "abce"


def test_deep_but_allowed():
    n = chat.DEPTH - 1
    assert chat.compiled("{% if true %}" * n + "x" + "{% endif %}" * n)([])[0] == "x"
    assert chat.compiled("{{ " + "(" * n + "1" + ")" * n + " }}")([])[0] == "1"
    assert chat.compiled("{% for a in messages %}" * n + "{{ " + "1+" * (chat.LENGTH - 1) + "z }}" + "{% endfor %}" * n)([{"role": "r"}])[0] == str(chat.LENGTH - 1)


def test_constants_fold():
    tree = chat.fold(chat.parse("{% if 1 == 1 %}a{% else %}{{ x }}{% endif %}{{ 'b' | raw }}c"))
    assert tree == ("block", ("text", "abc"))


def test_rows(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (1, 1, "assistant", "b</s>"), (1, None, "system", "s"), (2, 0, None, "x " * 40_000), (None, 3, "user", "n"), (None, 3, "assistant", "n")]
    df = spark.createDataFrame([(*r, "extra", 5) for r in rows], "conv_id long, turn long, role string, text string, formatted string, turns int")
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, None} and got[1].n_turns == 4 and got[None].n_turns == 2
    assert got[1].turns_sha256 == sha("system\ns\nuser\n\nassistant\nb</s>\nassistant\nb</s>\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (10, sha("b</s>b</s>"))
    assert got[2].turns_sha256 == sha("\n" + "x " * 40_000 + "\n") and got[2].loss_chars == 0
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0

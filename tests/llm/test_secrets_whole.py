import random
import string

from weftgraph.llm import secret_scan

rng = random.Random(3)
blob = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))


def literals(text):
    return [text[a:b] for a, b, k in secret_scan.scan(text) if k == "literal"]


def test_no_length_hides_a_literal():
    long = "Zx9/" + blob(6000)
    assert literals(f'"client-key-data": "{long}"') == [long]
    assert literals(f"<pwd>{long}</pwd>") == [long]
    name = "x" * 200 + "_private_key"
    assert literals(f'{name} = "aB3$efgh/IJ"') == ["aB3$efgh/IJ"]
    assert literals("x = 'pinned'; user_" + "y" * 90 + ".pwd = 'aB3$efgh/IJ'") == ["aB3$efgh/IJ"]


def test_no_number_of_operands_hides_a_literal():
    parts = [f"aB{i:02}$" for i in range(40)]
    total = " + ".join(f'"{p}"' for p in parts)
    assert literals(f"pwd = {total}") == parts
    assert literals(f"a = {total}\npwd = a") == parts
    assert literals("\n".join(["v0 = 'aB1$xyz'", *[f"v{i + 1} = v{i} + v{i}" for i in range(300)], "pwd = v300"])) == ["aB1$xyz"]
    assert literals("\n".join(["pwd = 'aB1$xyz'", *["pwd = pwd + 'Q7#k'"] * 5000])).count("Q7#k") == 5000


def test_pin_is_found_without_other_words():
    assert literals('user_pin = "aB3$efghIJklmnop"') == ["aB3$efghIJklmnop"]


def test_a_sum_scores_as_its_text_does():
    for whole in ("your" + blob(20), "<" + blob(20) + ">", "${" + blob(20) + "}", "%" + blob(20) + "%", "X" * 30, "*" * 20, "." * 20, blob(20), blob(8), "changeme", "two words " + blob(9), "undefined"):
        for cut in (1, 3, len(whole) - 1):
            v = secret_scan.Value(parts=(secret_scan.Value(whole[:cut], 0), secret_scan.Value(whole[cut:], cut)))
            assert abs(v.score() - secret_scan.literal_score(whole)) < 1e-9 and v.n == len(whole)


def test_linear_time():
    import time

    for text in ("key=" * 100_000, 'key="' * 100_000, "a" * 400_000, "key='\\" * 100_000, "<key>" * 80_000, 'key="a"' + '+"a"' * 100_000, "key = a + " * 50_000):
        began = time.time()
        secret_scan.scan(text)
        assert time.time() - began < 10, text[:10]


SENSITIVE = ["db_passphrase", "apiSigningKey", "credential", "user_pwd", "auth_cookie_jwt", "PRIVATE_KEY"]
HARMLESS = ["colour", "pageTitle", "row_count", "credential_name", "Width"]
secret = lambda: rng.choice(string.ascii_letters) + "".join(rng.choice(string.ascii_letters + string.digits + "$!%@") for _ in range(rng.randint(14, 30))) + "aZ7$"

#: Ways to write that a name has a literal; {n} and {v} stand for them. The quote is put in by the text.
FORMS = [
    '{n} = "{v}"', "{n} = '{v}'", '{n}: "{v}"', '"{n}": "{v}",', "{n} := `{v}`", '"{n}" => "{v}"', 'const {n}: string = "{v}";', '{n}: str = "{v}"', '{n}: Optional[str] = "{v}"', 'let {n}: string | undefined = "{v}";',
    'cfg["{n}"] = "{v}"', "a['x']['{n}'] = '{v}'", '{n} = ("{v}")', '{n} = (\n    "{v}"\n)', '{n} = f"{v}"', "{n} = rb'{v}'", '{n} = base64.b64decode("{v}")', '{n} = os.environ.get("X", "{v}")', '{n} = wrap(trim("{v}"))',
    '{n} += "{v}"', 'left, {n} = 1, "{v}"', "define('{n}', '{v}')", 'os.setenv("{n}", "{v}")', '<{n} type="a">{v}</{n}>', "<{n}><![CDATA[{v}]]></{n}>", "{n}: |2\n    {v}\nend: 1", "{n}: >-\n  {v}\nend: 1", '# {n} = "{v}"', "// {n}: '{v}'",
    '/* {n} = "{v}" */', "<!-- {n}: '{v}' -->", 'f(x=1, {n}="{v}")', 'String {n} = new String("{v}");', '{n} = other or "{v}"', '{n} = a if b else "{v}"', '{n} = """{v}"""', 'k = "{v}"\n{n} = k', 'k = "{v}"\nj = k\n{n} = j',
]
PROSE = ["The end of it - isn't that so? (Yes; it is.)", "1 < 2 and 3 > 2", "a, b, c", "", "* item one", "x == y", "see [1], {2}", "don't"]


def test_a_grammar_of_assignments():
    """Each literal given to a sensitive name is found at its place, none given to another name is."""
    for _ in range(1000):
        text, want = "", set()
        for _ in range(rng.randint(1, 6)):
            form, name = rng.choice(FORMS), rng.choice(SENSITIVE + HARMLESS)
            value = secret()
            head = form.index("{v}")
            said = form[:head].replace("{n}", name)
            if name in SENSITIVE:
                want.add((len(text) + len(said), len(text) + len(said) + len(value)))
            text += said + value + form[head + 3 :].replace("{n}", name) + "\n" + rng.choice(PROSE) + "\n"
        base = [s for s in secret_scan.scan(text) if s[2] != "literal"]
        got = {(a, b) for a, b, k in secret_scan.scan(text) if k == "literal"}
        covered = {(a, b) for a, b in want if any(x <= a and b <= y for x, y, _ in base)}
        assert got == want - covered, (text, [text[a:b] for a, b in got ^ (want - covered)])


def test_comparisons_and_look_ups_give_nothing():
    for text in ('if pwd == "aB3$efgh/IJkl9Zq"', 'pwd != "aB3$efgh/IJkl9Zq"', 'pwd = os.getenv("DB_Pwd$Value/9")', 'pwd: str', "pwd = (((", "a = ){", "<pwd><b", 'x["pwd"]', '"pwd" "aB3$efgh/IJkl9Zq"'):
        assert literals(text) == []


def test_time_grows_with_the_length_of_a_text():
    import time

    def took(text):
        began = time.perf_counter()
        secret_scan.scan(text)
        return time.perf_counter() - began

    for part in ("pwd = (", "pwd: Optional[", '"pwd" ', "<pwd a", "pwd, ", "pwd = a if ", "pwd = f(g(", "# pwd = # ", "x" * 20 + ".", "pwd+="):
        small, large = took(part * 2000), took(part * 16000)
        assert large < 40 * small + 0.5, part

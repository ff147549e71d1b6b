"""Rules: expected hits of the example programs, one example per rule, brute force."""

import re

import pytest

from reviewlake import issues, review
from reviewlake.operators import rules
from reviewlake.packs.languages import EXTENSIONS
from reviewlake.packs.rules import FOUND, Rule, builtin_packs, override, with_rules
from reviewlake.sources.tables import PROGRAMS

EXPECTED = {
    "Python": "PYS003@4 PYS002@5 PYS004@6 PYP005@7 PYP004@8 PYS006@9 PY004@2",
    "JavaScript": "JS001@1 JS002@3 JS003@3 JSP003@4 JSS001@4 JSS004@5 JSP004@6",
    "TypeScript": "TS003@2 TS001@3 JS001@4 TS002@4 JSS007@5",
    "Java": "JA001@4 JA002@4 JA003@4 JSec003@5 JSec001@6",
    "C": "C002@4 CSec001@4 CSec002@5 C001@6",
    "C++": "CPP001@2 CPP002@4 CPPPP001@5 CSec004@6",
    "C#": "CS001@4 CS002@4 CSSec004@5 CSP001@6",
    "PHP": "PHPSec001@3 PHP001@4 PHPSec001@4 PHPSec006@5 PHPPERF001@6",
    "HTML": "HTML001@1 HTML002@1 HTML003@1 HTML004@3 HTMLSec003@4 HTMLSec002@5 HTMLSec004@6",
    "CSS": "CSSP001@1 CSS001@2 CSS002@2 CSSec002@4",
    "SQL": "SQL001@2 SQL002@2 SQLSec002@3 SQLP001@4",
    "Bash": "SH001@2 SH002@2 SHSec001@2 SHSec004@3 SHP001@4 SHSec005@5",
    "JSON": "JSONSec001@2 JSONSec002@3",
}

# One line per line rule that must fire it.
EXAMPLES = {
    "PYS001": 'cur.execute("SELECT * FROM t WHERE a = %s" % x)', "PYS002": 'passwd = "hunter22"', "PYS003": "eval (x)",
    "PYS004": "os.system('ls')", "PYS005": "run(x, shell = True)", "PYS006": "hashlib.sha1(x)",
    "PYS007": "pickle.loads(b)", "PYS008": "open('../etc/passwd')", "PYS009": "k = '0123456789abcdef0123456789abcdef'",
    "PYP003": "a += str", "PYP004": "out.append(x)", "PYP005": "for i in range(len(x)): pass", "PYP006": "os.listdir(p)",
    "JS001": "var x = 1", "JS002": "if (a == b) {}", "JS003": "console.debug(1)", "JSS001": "eval(x)",
    "JSS002": "el.innerHTML = y", "JSS003": "document.write(x)", "JSS004": "const key: 'abcdef'; secret = 'abcdef'",
    "JSS005": "with (obj) {}", "JSS006": "new Function('x')", "JSS007": "location.href = u",
    "JSP001": "for (a) { for (b) {} }", "JSP002": "document.querySelector('a')", "JSP003": "el.innerHTML += 'x'",
    "JSP004": "JSON.parse(JSON.stringify(x))", "TS001": "let a: any", "TS002": "x as any", "TS003": "// @ts-ignore",
    "JA001": "} catch (Exception e) {", "JA002": "catch (IOException e) { }", "JA003": "System.out.print(1)",
    "JSec001": 'String secret = "abcdef";', "JSec002": "Statement s; s.execute(a + b)",
    "JSec003": "Runtime.getRuntime().exec(c)", "JSec004": "md5 .digest()", "JSec005": "new ObjectInputStream(in)",
    "JSec006": 'r.setHeader("Access-Control-Allow-Origin", "*")', "JP001": 'String a = "b" + c;',
    "JP002": "new int[] {1}", "C001": "goto out;", "C002": "gets(b);", "CSec001": "gets(b);", "CSec002": "strcpy(a,b);",
    "CSec003": "sprintf(a, b);", "CSec004": "system(c);", "CSec005": "p = malloc(4);", "CSec006": 'password = "abcd"',
    "CP001": "p = malloc(4);", "CPP001": "using namespace std;", "CPP002": "T* t = new T();", "CPPPP001": "v.push_back(1);",
    "CS001": "catch (Exception e)", "CS002": "Console.Write(1);", "CSSec001|C#": 'apikey = "abcdef"',
    "CSSec002|C#": "new SqlCommand(a + b)", "CSSec003": "Process.Start(x)", "CSSec004": "MD5.Create()",
    "CSP001": 'string s += "x"', "PHP001": "echo $_GET;", "PHPSec001": "$_REQUEST['a']",
    "PHPSec002": "mysql_query($_x)", "PHPSec003": "eval($x)", "PHPSec004": "shell_exec($x)", "PHPSec005": "$passwd = 'abcdef'",
    "PHPSec006": "md5($x)", "PHPPERF001": "foreach ($a as $b) { $c->query($d); }", "HTML004": "<img src=x>",
    "HTMLSec001": "<a onclick='eval(1)'>", "HTMLSec002": "<script>1</script>", "HTMLSec003": "<a href='JavaScript:1'>",
    "HTMLSec004": "<!-- the Password -->", "CSS001": "a { b: c !important }", "CSS002": "#main {",
    "CSSec001|CSS": "width: expression(1)", "CSSec002|CSS": "url('data:x')", "SQL001": "select  * from t",
    "SQL002": "with (nolock)", "SQLSec001": "'a' || b", "SQLSec002": "grant all on t", "SQLP001": "not in (select 1)",
    "SQLP002": "function f where x", "SH001": "if [ -f x ]; then", "SH002": "[ a == b ]", "SHSec001": "eval x",
    "SHSec002": "secret='abcdef'", "SHSec003": "curl --insecure u", "SHSec004": "chmod  777 f", "SHSec005": "echo $*",
    "SHP001": "cat f | grep x", "JSONSec001": '{"token": "abcdef"}', "JSONSec002": '{"pem": 1}',
}

SUFFIX = {language: ext for ext, language in reversed(list(EXTENSIONS.items()))}


def hits(df):
    return sorted(f"{r.rule_id}@{r.line_number}" for r in df.select("rule_id", "line_number").collect())


def test_expected_hits_of_the_example_programs(corpus):
    files = {f"a{ext}": (language, text) for language, ext, text in PROGRAMS}
    rows = issues(review(corpus(files))).select("language", "rule_id", "line_number").collect()
    for language, expected in EXPECTED.items():
        got = sorted(f"{r.rule_id}@{r.line_number}" for r in rows if r.language == language)
        assert got == sorted(expected.split()), language


def brute_line_hits(rule, content):
    """The same rule with Python's regex engine, line by line."""
    flags = (re.I if "i" in rule.flags else 0) | (re.S if "s" in rule.flags else 0)
    lines = content.splitlines(keepends=True)
    for i, line in enumerate(lines, 1):
        ok = (re.search(rule.pattern, line, flags) and all(t in line for t in rule.has)
              and not any(t in line for t in rule.lacks)
              and not (rule.lacks_pattern and re.search(rule.lacks_pattern, line, flags)))
        if ok and rule.kind == "follows":
            ok = re.search(rule.near, lines[max(0, i - 5)])
        if ok and rule.kind == "unfreed":
            start = content.find(line.strip())
            ok = rule.near not in content[start:start + rule.threshold]
        if ok:
            yield i


def test_every_line_rule_fires_and_agrees_with_brute_force(corpus):
    packs = builtin_packs()
    everything = "\n".join(EXAMPLES.values()) + "\n\n  trailing ==\né == ü\n<img alt=x><img\nalt=y>\ncafé.append(x)\x0bvar z"
    files = {f"all{SUFFIX[language]}": (language, everything) for language in packs}
    files |= {f"own{i}{SUFFIX[key.partition('|')[2] or lang]}": (key.partition("|")[2] or lang, line)
              for i, (key, line) in enumerate(EXAMPLES.items())
              for lang in [next(k for k, pack in packs.items() if any(r.rule_id == key.partition('|')[0] for r in pack))]}
    got = {}
    for r in issues(review(corpus(files))).select("path", "rule_id", "line_number").collect():
        got.setdefault((r.path, r.rule_id), []).append(r.line_number)
    fired = set()
    for path, (language, content) in files.items():
        try:
            compile(content, path, "exec")
            parses = True
        except SyntaxError:
            parses = False
        for rule in packs[language]:
            if rule.kind not in ("line", "follows", "unfreed") or (rule.needs_tree and not parses):
                continue
            expected = list(brute_line_hits(rule, content))
            assert sorted(got.get((path, rule.rule_id), [])) == expected, (path, rule.rule_id)
            fired |= {(language, rule.rule_id)} if expected else set()
    missing = {(k, r.rule_id) for k, pack in packs.items() for r in pack if r.kind in ("line", "follows", "unfreed")} - fired
    # In the all-in-one Python file the tree rules are off; each fires in its own file.
    assert not missing, missing


def test_file_rules(corpus):
    branches = "\n".join(f"if (a{i}) {{ x(); }}" for i in range(16))
    files = {"c.js": ("JavaScript", branches), "m.html": ("HTML", "<!doctype html><title>x</title><meta charset=a>" + "<script></script>" * 6),
             "big.json": ("JSON", '{"a": "' + "x" * 100_001 + '"}'), "bad.json": ("JSON", '{"a": 1,}'),
             "ok.jsonc": ("JSON", '{"a": 1} // note')}
    rows = {(r.path, r.rule_id): r.description for r in issues(review(corpus(files))).collect()}
    assert rows[("c.js", "JS004")] == "Complexity is 17."
    assert rows[("m.html", "HTMLP001")] == "Found 6 script tags. Bundle JS files."
    assert not {r for p, r in rows if p == "m.html"} & {"HTML001", "HTML002", "HTML003"}
    assert rows[("big.json", "JSON002")] == "File is 97KB. Consider splitting."
    assert rows[("bad.json", "JSON001")].startswith("JSON parse error at line 1: ")
    assert not any(p == "ok.jsonc" for p, _ in rows)


def test_shaping_and_order(corpus):
    long_line = "    eval(" + "x" * 200 + ")"
    files = {"a.py": ("Python", 'def f():\n    """d"""\n' + long_line + "\n    passwd = 'abcdef'  # {line} {text}\n")}
    rows = rules.order_issues(issues(review(corpus(files)))).collect()
    assert [r.rule_id for r in rows] == ["PYS002", "PYS003"]
    assert rows[0].description == "Found at line 4: passwd = 'abcdef'  # {line} {text}"
    assert rows[1].code_snippet == long_line.strip()[:120]
    assert rows[1].description == f"Found at line 3: {long_line.strip()[:80]}"


def test_inheritance():
    packs = builtin_packs()
    ids = lambda k: {r.rule_id for r in packs[k]}
    assert ids("JavaScript") <= ids("TypeScript") and {"TS001", "TS002", "TS003"} <= ids("TypeScript")
    assert {"C001", "CSec001", "CPP001", "CPPPP001"} <= ids("C++") and "CP001" not in ids("C++")


def test_user_rules(corpus):
    rule = Rule("U1", "static", "HIGH", "style", "line", "", "needle", "Needle", FOUND)
    packs = with_rules(builtin_packs(), {"SQL": (rule,)})
    done = review(corpus({"a.sql": ("SQL", "x\nneedle")}), packs=packs)
    assert hits(issues(done, packs)) == ["U1@2"]
    with pytest.raises(ValueError):
        with_rules(builtin_packs(), {"SQL": (Rule("SQL001", "static", "LOW", "style", "line", "", "x", "x", "x"),)})
    changed = override(builtin_packs(), "SQL", "SQL001", severity="INFO")
    assert [r.severity for r in changed["SQL"] if r.rule_id == "SQL001"] == ["INFO"]


def test_rule_counts():
    own = {(language, r.rule_id) for language, pack in builtin_packs().items() for r in pack}
    assert len({r.rule_id + r.title for pack in builtin_packs().values() for r in pack}) == 114
    assert len(own) == sum(len(p) for p in builtin_packs().values())

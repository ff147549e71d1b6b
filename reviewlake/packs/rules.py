"""Detection rules per language, in detection order."""

from __future__ import annotations

from dataclasses import dataclass, replace

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
CATEGORIES = ("security", "performance", "maintainability", "style", "bug")
PHASES = ("static", "security", "performance")


@dataclass(frozen=True)
class Rule:
    """One detection rule.

    ``kind`` says how it fires: ``line`` (regex on a line), ``absent`` /
    ``count`` (regex on the whole content), ``complex`` (cyclomatic complexity
    above ``threshold``), ``large`` (content longer than ``threshold``),
    ``follows`` (line regex plus ``near`` four lines above), ``unfreed`` (line
    regex without ``near`` in the next 500 characters) and ``syntax`` (reported
    by the syntax helper).  In ``description``, ``{line}``, ``{text}`` and
    ``{n}`` stand for line number, line text and the measured value.
    """

    rule_id: str
    phase: str
    severity: str
    category: str
    kind: str
    flags: str
    pattern: str
    title: str
    description: str
    suggestion: str = ""
    has: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()
    lacks_pattern: str = ""
    near: str = ""
    threshold: int = 0
    reason: str = ""
    needs_tree: bool = False


FOUND = "Found at line {line}: {text}"
FOUND_BARE = "Found at line {line}."
LINE = "Line {line}: {text}"
LINE_BARE = "Line {line}."

# --- Fixed values -----------------------------------------------------------
PYTHON = (
    Rule("PY001", "static", "CRITICAL", "bug", "syntax", "", "", "Syntax Error", "{n}"),
    Rule("PY002", "static", "MEDIUM", "maintainability", "syntax", "", "", "Long Method", "{n}", "Break this function into smaller, focused functions.", reason="Functions over 50 lines are harder to understand and test."),
    Rule("PY003", "static", "MEDIUM", "style", "syntax", "", "", "Long Parameter List", "{n}", "Consider using a config object or dataclass."),
    Rule("PY004", "static", "LOW", "style", "syntax", "", "", "Missing Docstring", "{n}", "Add a docstring describing purpose, args, and return value."),
    Rule("PY005", "static", "LOW", "style", "syntax", "", "", "Magic Numbers", "{n}", "Extract magic numbers into named constants."),
    Rule("PY006", "static", "HIGH", "maintainability", "complex", "", "", "High Cyclomatic Complexity", "Cyclomatic complexity is {n} (threshold: 15).", "Simplify conditional logic or split into smaller functions.", threshold=15, needs_tree=True),
    Rule("PY007", "static", "MEDIUM", "bug", "syntax", "", "", "Bare Except Clause", "Using bare `except:` catches all exceptions including system exits.", "Catch specific exceptions: `except ValueError:` or `except Exception:`"),
    Rule("PY008", "static", "INFO", "style", "syntax", "", "", "Potentially Unused Import", "{n}", "Remove unused imports to keep code clean."),
    Rule("PYS001", "security", "HIGH", "security", "line", "i", r'(execute|query)\s*\(\s*["\']?\s*SELECT.*%[s|d]', "SQL Injection Risk", FOUND, "Use parameterized queries instead of string formatting."),
    Rule("PYS002", "security", "CRITICAL", "security", "line", "i", r'(password|passwd|pwd|secret|api_key|apikey)\s*=\s*["\'][^"\']{4,}["\']', "Hardcoded Credential", FOUND, "Move secrets to environment variables or a secure vault."),
    Rule("PYS003", "security", "HIGH", "security", "line", "i", r"\beval\s*\(", "Unsafe eval() Usage", FOUND, "eval() can execute arbitrary code. Use ast.literal_eval() for data."),
    Rule("PYS004", "security", "HIGH", "security", "line", "i", r"os\.system\s*\(", "Shell Command Injection Risk", FOUND, "Use subprocess with a list of arguments and shell=False."),
    Rule("PYS005", "security", "HIGH", "security", "line", "i", r"shell\s*=\s*True", "Subprocess with shell=True", FOUND, "Avoid shell=True to prevent command injection."),
    Rule("PYS006", "security", "MEDIUM", "security", "line", "i", r"\b(md5|sha1)\s*\(", "Weak Cryptographic Hash", FOUND, "Use SHA-256 or stronger for security purposes."),
    Rule("PYS007", "security", "HIGH", "security", "line", "i", r"\bpickle\.loads?\s*\(", "Insecure Deserialization (pickle)", FOUND, "pickle.load() can execute arbitrary code. Use JSON or safer formats."),
    Rule("PYS008", "security", "HIGH", "security", "line", "i", r"open\s*\([^)]*\.\.[^)]*\)", "Directory Traversal Risk", FOUND, "Validate and sanitize file paths before opening."),
    Rule("PYS009", "security", "MEDIUM", "security", "line", "i", r'["\'][A-Za-z0-9]{32,}["\']', "Possible Hardcoded API Key", FOUND, "Move API keys to environment variables."),
    Rule("PYP001", "performance", "HIGH", "performance", "syntax", "", "", "Deeply Nested Loops", "{n}", "Consider using vectorized operations, dictionaries, or algorithmic improvements."),
    Rule("PYP002", "performance", "MEDIUM", "performance", "syntax", "", "", "Nested Loops", "{n}", "Consider if the nested loop can be replaced with a set/dict lookup."),
    Rule("PYP003", "performance", "MEDIUM", "performance", "line", "", r"\+\s*=.*\bstr\b|\bstr\b.*\+=", "String Concatenation in Loop", FOUND_BARE, "Use ''.join() instead of += for string concatenation in loops.", needs_tree=True),
    Rule("PYP004", "performance", "INFO", "performance", "line", "", r"\.append\s*\(.*\)\s*$", "List append in possible loop", FOUND_BARE, "Consider list comprehensions for better performance.", needs_tree=True),
    Rule("PYP005", "performance", "LOW", "performance", "line", "", r"\brange\s*\(\s*len\s*\(", "range(len()) Anti-Pattern", FOUND_BARE, "Use enumerate() instead of range(len()).", needs_tree=True),
    Rule("PYP006", "performance", "INFO", "performance", "line", "", r"\bos\.listdir\b", "os.listdir() Usage", FOUND_BARE, "Consider os.scandir() which is faster for large directories.", needs_tree=True),
)

JAVASCRIPT = (
    Rule("JS001", "static", "LOW", "style", "line", "", r"\bvar\s+\w+", "Use of 'var'", "'var' has function scope and can cause bugs. Use 'const' or 'let'.", "Replace 'var' with 'const' (if not reassigned) or 'let'."),
    Rule("JS002", "static", "MEDIUM", "bug", "line", "", r"[^=!<>]==[^=]", "Loose Equality (==)", "Using '==' instead of '===' can cause unexpected type coercion.", "Use strict equality '===' to avoid type coercion bugs.", lacks=("===",)),
    Rule("JS003", "static", "INFO", "style", "line", "", r"\bconsole\.(log|debug|warn)\s*\(", "Console Statement", "Debug console statement found.", "Remove console statements before production deployment."),
    Rule("JS004", "static", "HIGH", "maintainability", "complex", "", "", "High Cyclomatic Complexity", "Complexity is {n}.", "Refactor complex logic into smaller functions.", threshold=15),
    Rule("JSS001", "security", "HIGH", "security", "line", "i", r"\beval\s*\(", "Unsafe eval()", FOUND, "Use JSON.parse() or Function() constructor carefully."),
    Rule("JSS002", "security", "HIGH", "security", "line", "i", r"innerHTML\s*=", "XSS via innerHTML", FOUND, "Use textContent or DOMPurify to sanitize HTML."),
    Rule("JSS003", "security", "MEDIUM", "security", "line", "i", r"document\.write\s*\(", "Unsafe document.write()", FOUND, "Avoid document.write(); use DOM manipulation instead."),
    Rule("JSS004", "security", "CRITICAL", "security", "line", "i", r'(password|secret|key)\s*[:=]\s*["\'][^"\']{4,}["\']', "Hardcoded Credential", FOUND, "Store secrets in environment variables, never in source."),
    Rule("JSS005", "security", "MEDIUM", "security", "line", "i", r"\bwith\s*\(", "Dangerous 'with' Statement", FOUND, "Avoid 'with' — it makes code unpredictable."),
    Rule("JSS006", "security", "HIGH", "security", "line", "i", r"new Function\s*\(", "Dynamic Function Creation", FOUND, "new Function() is similar to eval() — avoid when possible."),
    Rule("JSS007", "security", "MEDIUM", "security", "line", "i", r"location\.href\s*=", "Open Redirect Risk", FOUND, "Validate redirect URLs against an allowlist."),
    Rule("JSP001", "performance", "MEDIUM", "performance", "line", "", r"for\s*\([^)]*\)\s*\{[^}]*for\s*\(", "Nested Loop", FOUND_BARE, "Nested loops may cause O(n²) complexity. Consider algorithmic improvements."),
    Rule("JSP002", "performance", "INFO", "performance", "line", "", r"document\.getElementById|querySelector", "DOM Query in Possible Loop", FOUND_BARE, "Cache DOM queries outside loops to avoid reflow."),
    Rule("JSP003", "performance", "MEDIUM", "performance", "line", "", r"\.innerHTML\s*\+=", "Inefficient innerHTML Concatenation", FOUND_BARE, "Use DocumentFragment or array.join() for batch DOM updates."),
    Rule("JSP004", "performance", "LOW", "performance", "line", "", r"\bJSON\.parse\s*\(\s*JSON\.stringify", "Deep Clone via JSON", FOUND_BARE, "Use structuredClone() or a proper deep-clone library."),
)

TYPESCRIPT = (
    Rule("TS001", "static", "MEDIUM", "style", "line", "", r":\s*any\b", "TypeScript 'any' Type", "Using 'any' defeats TypeScript's type safety.", "Use a specific type, 'unknown', or a generic constraint."),
    Rule("TS002", "static", "HIGH", "bug", "line", "", r"\bas\s+any\b", "Type Cast to 'any'", "Casting to 'any' removes all type safety.", "Use proper type guards or 'as unknown as TargetType'."),
    Rule("TS003", "static", "MEDIUM", "style", "line", "", r"@ts-ignore", "TypeScript Error Suppression", "@ts-ignore suppresses type errors silently.", "Fix the underlying type error instead of suppressing it."),
)

JAVA = (
    Rule("JA001", "static", "MEDIUM", "bug", "line", "", r"catch\s*\(\s*Exception\s+\w+\s*\)", "Catch Generic Exception", "Catching the generic Exception class hides bugs.", "Catch specific exception types."),
    Rule("JA002", "static", "HIGH", "bug", "line", "", r"catch\s*\([^)]+\)\s*\{\s*\}", "Empty Catch Block", "Silently swallowing exceptions is dangerous.", "Log the exception or re-throw it."),
    Rule("JA003", "static", "INFO", "style", "line", "", r"System\.out\.(print|println)\s*\(", "System.out.println Usage", "Use a logging framework instead of print statements.", 'Use SLF4J or Log4j: logger.info("message");'),
    Rule("JA004", "static", "HIGH", "maintainability", "complex", "", "", "High Cyclomatic Complexity", "Complexity is {n}.", "Refactor into smaller methods.", threshold=15),
    Rule("JSec001", "security", "CRITICAL", "security", "line", "i", r'(password|passwd|secret|apikey)\s*=\s*"[^"]{4,}"', "Hardcoded Credential", LINE),
    Rule("JSec002", "security", "HIGH", "security", "line", "i", r"Statement.*execute.*\+", "SQL Injection Risk (String Concat)", LINE),
    Rule("JSec003", "security", "HIGH", "security", "line", "i", r"Runtime\.getRuntime\(\)\.exec\s*\(", "Command Injection Risk", LINE),
    Rule("JSec004", "security", "MEDIUM", "security", "line", "i", r"(MD5|SHA1)\s*\.", "Weak Hash Algorithm", LINE),
    Rule("JSec005", "security", "HIGH", "security", "line", "i", r"new\s+ObjectInputStream\s*\(", "Insecure Deserialization", LINE),
    Rule("JSec006", "security", "MEDIUM", "security", "line", "i", r'\.setHeader\s*\(\s*"Access-Control-Allow-Origin"\s*,\s*"\*"', "CORS Wildcard", LINE),
    Rule("JP001", "performance", "LOW", "performance", "line", "", r'\bString\s+\w+\s*=\s*"[^"]*"\s*\+', "String Concatenation", LINE_BARE, "Use StringBuilder for string concatenation."),
    Rule("JP002", "performance", "INFO", "performance", "line", "", r"\bnew\s+\w+\[]\s*\{", "Large Array Literal", LINE_BARE, "Consider using a collection instead."),
)

C = (
    Rule("C001", "static", "MEDIUM", "style", "line", "", r"\bgoto\b", "goto Statement", "goto makes control flow hard to follow.", "Restructure code to avoid goto."),
    Rule("C002", "static", "CRITICAL", "security", "line", "", r"\bgets\s*\(", "Dangerous gets() Function", "gets() is vulnerable to buffer overflow.", "Use fgets() with a size limit."),
    Rule("C003", "static", "HIGH", "maintainability", "complex", "", "", "High Complexity", "Complexity is {n}.", threshold=15),
    Rule("CSec001", "security", "CRITICAL", "security", "line", "i", r"\bgets\s*\(", "Buffer Overflow (gets)", LINE),
    Rule("CSec002", "security", "HIGH", "security", "line", "i", r"\bstrcpy\s*\(", "Buffer Overflow (strcpy)", LINE),
    Rule("CSec003", "security", "MEDIUM", "security", "line", "i", r"\bsprintf\s*\(", "Buffer Overflow (sprintf)", LINE),
    Rule("CSec004", "security", "HIGH", "security", "line", "i", r"\bsystem\s*\(", "Command Injection (system)", LINE),
    Rule("CSec005", "security", "LOW", "security", "line", "i", r"\bmalloc\s*\(", "malloc Without NULL Check", LINE),
    Rule("CSec006", "security", "CRITICAL", "security", "line", "i", r'(password|secret)\s*=\s*"[^"]{4,}"', "Hardcoded Credential", LINE),
    Rule("CP001", "performance", "HIGH", "performance", "unfreed", "", r"\bmalloc\s*\(.*\)\s*;", "Potential Memory Leak", "malloc() without corresponding free().", "Ensure every malloc() has a corresponding free().", near="free(", threshold=500),
)

CPP = (
    Rule("CPP001", "static", "MEDIUM", "style", "line", "", r"\busing namespace std\b", "'using namespace std'", "Pollutes global namespace and can cause ambiguity.", "Use explicit std:: prefix or selective using declarations."),
    Rule("CPP002", "static", "MEDIUM", "performance", "line", "", r"\bnew\s+\w+", "Raw new Without Smart Pointer", "Raw new can lead to memory leaks.", "Use std::unique_ptr or std::shared_ptr.", lacks=("unique_ptr", "shared_ptr")),
    Rule("CPPPP001", "performance", "INFO", "performance", "line", "", r"\bpush_back\s*\(", "push_back vs emplace_back", "emplace_back can be more efficient.", "Use emplace_back() to construct in-place."),
)

CSHARP = (
    Rule("CS001", "static", "MEDIUM", "bug", "line", "", r"\bcatch\s*\(\s*Exception\s+\w+\s*\)", "Catch Generic Exception", "Catching Exception hides specific errors.", "Catch specific exception types."),
    Rule("CS002", "static", "INFO", "style", "line", "", r"Console\.(Write|WriteLine)\s*\(", "Console Output", "Use ILogger instead of Console output."),
    Rule("CSSec001", "security", "CRITICAL", "security", "line", "i", r'(password|secret|apikey)\s*=\s*"[^"]{4,}"', "Hardcoded Credential", LINE_BARE),
    Rule("CSSec002", "security", "HIGH", "security", "line", "i", r"SqlCommand.*\+", "SQL Injection Risk", LINE_BARE),
    Rule("CSSec003", "security", "HIGH", "security", "line", "i", r"Process\.Start\s*\(", "Command Injection Risk", LINE_BARE),
    Rule("CSSec004", "security", "MEDIUM", "security", "line", "i", r"MD5\.Create\(\)", "Weak Hash (MD5)", LINE_BARE),
    Rule("CSP001", "performance", "MEDIUM", "performance", "line", "i", r"\+\s*=.*string|string.*\+=", "String Concatenation", "Use StringBuilder for repeated concatenation."),
)

PHP = (
    Rule("PHP001", "static", "CRITICAL", "security", "line", "", r"\becho\s+\$_", "XSS via echo $_", "Directly echoing user input is an XSS vulnerability.", "Use htmlspecialchars() to sanitize output."),
    Rule("PHP002", "static", "HIGH", "maintainability", "complex", "", "", "High Complexity", "Complexity is {n}.", threshold=15),
    Rule("PHPSec001", "security", "HIGH", "security", "line", "i", r"\$_(GET|POST|REQUEST|COOKIE)\[", "Unvalidated User Input", LINE_BARE),
    Rule("PHPSec002", "security", "CRITICAL", "security", "line", "i", r"mysql_query\s*\(.*\$_", "SQL Injection Risk", LINE_BARE),
    Rule("PHPSec003", "security", "HIGH", "security", "line", "i", r"\beval\s*\(", "eval() Usage", LINE_BARE),
    Rule("PHPSec004", "security", "HIGH", "security", "line", "i", r"\b(exec|system|shell_exec|passthru)\s*\(", "Command Injection", LINE_BARE),
    Rule("PHPSec005", "security", "CRITICAL", "security", "line", "i", r'(password|passwd|secret)\s*=\s*["\'][^"\']{4,}["\']', "Hardcoded Credential", LINE_BARE),
    Rule("PHPSec006", "security", "MEDIUM", "security", "line", "i", r"md5\s*\(", "Weak Hash (md5)", LINE_BARE),
    Rule("PHPPERF001", "performance", "HIGH", "performance", "follows", "", r"\bquery\s*\(", "Possible N+1 Query", "Database query inside a loop may cause N+1 problem.", "Use eager loading or batch queries.", near=r"\bfor\b|\bforeach\b|\bwhile\b", threshold=4),
)

HTML = (
    Rule("HTML001", "static", "MEDIUM", "style", "absent", "i", r"<!DOCTYPE html>", "Missing DOCTYPE", "HTML5 DOCTYPE declaration is missing.", "Add <!DOCTYPE html> at the top."),
    Rule("HTML002", "static", "LOW", "style", "absent", "i", r"<meta\s+[^>]*charset", "Missing Charset Meta", "Character encoding is not declared.", 'Add <meta charset="UTF-8">.'),
    Rule("HTML003", "static", "MEDIUM", "style", "absent", "i", r"<title>", "Missing <title>", "Page has no title element.", "Add a descriptive <title> for SEO."),
    Rule("HTML004", "static", "LOW", "style", "line", "i", r"<img\b(?![^>]*\balt=)", "Missing alt Attribute", "Image tag missing alt attribute.", 'Add alt="description" for accessibility.'),
    Rule("HTMLSec001", "security", "CRITICAL", "security", "line", "is", r'on\w+\s*=\s*["\'].*\beval\b', "Inline Event Handler with eval", LINE_BARE),
    Rule("HTMLSec002", "security", "INFO", "security", "line", "is", r"<script[^>]*>.*?</script>", "Inline Script Block", LINE_BARE),
    Rule("HTMLSec003", "security", "HIGH", "security", "line", "is", r"javascript:", "javascript: Protocol", LINE_BARE),
    Rule("HTMLSec004", "security", "CRITICAL", "security", "line", "is", r"<!--.*password.*-->", "Password in HTML Comment", LINE_BARE),
    Rule("HTMLP001", "performance", "MEDIUM", "performance", "count", "i", r"<script\b", "Many Script Tags", "Found {n} script tags. Bundle JS files.", "Use a bundler like Webpack or Vite.", threshold=5),
)

CSS = (
    Rule("CSS001", "static", "LOW", "style", "line", "", r"!important", "!important Override", "Using !important makes CSS hard to maintain.", "Increase selector specificity instead."),
    Rule("CSS002", "static", "LOW", "style", "line", "", r"#[a-zA-Z][\w-]+", "ID Selector in CSS", "ID selectors are too specific and hard to override.", "Use class selectors for reusability.", has=("{",)),
    Rule("CSSec001", "security", "CRITICAL", "security", "line", "i", r"expression\s*\(", "CSS expression() Usage", "CSS expression() can execute JavaScript."),
    Rule("CSSec002", "security", "MEDIUM", "security", "line", "i", r'url\s*\(\s*["\']?data:', "Data URI in CSS", "Data URIs can be used to embed malicious content."),
    Rule("CSSP001", "performance", "MEDIUM", "performance", "count", "", r"\*\s*\{", "Universal Selector (*)", "Universal selector matches all elements and is slow.", "Use specific selectors.", threshold=0),
)

SQL = (
    Rule("SQL001", "static", "MEDIUM", "performance", "line", "i", r"\bSELECT\s+\*", "SELECT * Usage", "SELECT * fetches all columns, including unnecessary ones.", "List only the columns you need."),
    Rule("SQL002", "static", "HIGH", "bug", "line", "i", r"\bNOLOCK\b", "NOLOCK Hint", "NOLOCK can cause dirty reads.", "Use proper transaction isolation levels."),
    Rule("SQLSec001", "security", "CRITICAL", "security", "line", "", r"'\s*\+|'\s*\|\|", "SQL Injection via Concatenation", "String concatenation in SQL is injection-prone.", "Use parameterized queries or stored procedures."),
    Rule("SQLSec002", "security", "HIGH", "security", "line", "i", r"\bGRANT\s+ALL\b", "GRANT ALL Privileges", "Granting all privileges is a security risk.", "Grant only the minimum required privileges."),
    Rule("SQLP001", "performance", "MEDIUM", "performance", "line", "i", r"\bNOT IN\s*\(", "NOT IN with Subquery", "NOT IN can be slow with large datasets or NULLs.", "Use NOT EXISTS or LEFT JOIN for better performance."),
    Rule("SQLP002", "performance", "HIGH", "performance", "line", "i", r"\bFUNCTION\b.*\bWHERE\b", "Function in WHERE Clause", "Functions in WHERE prevent index usage.", "Restructure query to avoid function calls on indexed columns."),
)

BASH = (
    Rule("SH001", "static", "LOW", "style", "line", "", r"\[ .+ \]", "Use [[ ]] Instead of [ ]", "[[ ]] is safer and supports more features.", lacks_pattern=r"\[\[ .+ \]\]"),
    Rule("SH002", "static", "MEDIUM", "bug", "line", "", r"==[^\=]", "String Comparison in Single Brackets", "Use = inside [ ] or == inside [[ ]].", lacks=("[[",)),
    Rule("SHSec001", "security", "HIGH", "security", "line", "i", r"\beval\s+", "eval Usage", LINE_BARE),
    Rule("SHSec002", "security", "CRITICAL", "security", "line", "i", r'(password|secret|key)\s*=\s*["\'][^"\']{4,}["\']', "Hardcoded Credential", LINE_BARE),
    Rule("SHSec003", "security", "HIGH", "security", "line", "i", r"curl\s+.*-k\b|curl\s+.*--insecure", "Insecure curl (--insecure)", LINE_BARE),
    Rule("SHSec004", "security", "HIGH", "security", "line", "i", r"chmod\s+777", "Dangerous chmod 777", LINE_BARE),
    Rule("SHSec005", "security", "MEDIUM", "security", "line", "i", r"\$\*|\$@", "Unquoted Shell Variables", LINE_BARE),
    Rule("SHP001", "performance", "INFO", "performance", "line", "", r"\bcat\s+\S+\s*\|\s*grep\b", "Useless Use of cat", "'cat file | grep' can be simplified to 'grep pattern file'."),
)

JSON = (
    Rule("JSON001", "static", "CRITICAL", "bug", "syntax", "", "", "JSON Parse Error", "{n}"),
    Rule("JSON002", "static", "LOW", "performance", "large", "", "", "Large JSON File", "File is {n}KB. Consider splitting.", threshold=100000),
    Rule("JSONSec001", "security", "CRITICAL", "security", "line", "i", r'"(password|passwd|secret|api_key|apikey|token)"\s*:\s*"[^"]{4,}"', "Hardcoded Credential", LINE_BARE),
    Rule("JSONSec002", "security", "CRITICAL", "security", "line", "i", r'"(private_key|certificate|pem)"\s*:', "Private Key Data", LINE_BARE),
)
# ----------------------------------------------------------------------------


def _phase(rules, *phases):
    return tuple(r for r in rules if r.phase in phases)


def builtin_packs() -> dict[str, tuple[Rule, ...]]:
    """Rules that apply to each language, in detection order.

    TypeScript takes every JavaScript rule plus its own static rules; C++ takes
    C's static and security rules but only its own performance rules.
    """
    return {
        "Python": PYTHON,
        "JavaScript": JAVASCRIPT,
        "TypeScript": _phase(JAVASCRIPT, "static") + TYPESCRIPT + _phase(JAVASCRIPT, "security", "performance"),
        "Java": JAVA,
        "C": C,
        "C++": _phase(C, "static") + _phase(CPP, "static") + _phase(C, "security") + _phase(CPP, "performance"),
        "C#": CSHARP,
        "PHP": PHP,
        "HTML": HTML,
        "CSS": CSS,
        "SQL": SQL,
        "Bash": BASH,
        "JSON": JSON,
    }


def with_rules(packs: dict[str, tuple[Rule, ...]], extra: dict[str, tuple[Rule, ...]]) -> dict[str, tuple[Rule, ...]]:
    """Add user rules to the packs; they run last within their phase."""
    merged = dict(packs)
    for language, rules in extra.items():
        known = {r.rule_id for r in merged.get(language, ())}
        clash = known & {r.rule_id for r in rules}
        if clash:
            raise ValueError(f"rule ids already used for {language}: {sorted(clash)}")
        merged[language] = tuple(
            r for phase in PHASES for r in (*merged.get(language, ()), *rules) if r.phase == phase
        )
    return merged


def override(packs, language: str, rule_id: str, **changes):
    """Change fields of one rule, e.g. its severity or threshold."""
    rules = tuple(replace(r, **changes) if r.rule_id == rule_id else r for r in packs[language])
    return {**packs, language: rules}

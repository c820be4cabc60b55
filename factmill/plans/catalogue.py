"""Default patterns of sources, sinks and sanitizers: a compact set of the common platforms' public interfaces. Fixed values.

Each line is: methods | class or - | type | severity or cwe,severity,positions | languages. Projects bring their own frames where they need more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import taint
from .rules import RULES

SOURCES = """
getParameter getParameterValues getParameterMap getQueryString | HttpServletRequest | http_param | high | java
getHeader getHeaders | HttpServletRequest | http_header | high | java
getCookies | HttpServletRequest | http_cookie | high | java
getInputStream getReader | HttpServletRequest | http_body | high | java
getPathInfo getRequestURI getPathVariable | HttpServletRequest | http_path | high | java
readLine nextLine next | BufferedReader | io_input | medium | java
getenv getProperty | System | env_input | low | java
getString getObject | ResultSet | db_input | medium | java
query param params body | req | http_param | high | javascript typescript
header headers | req | http_header | high | javascript typescript
get getlist | request.args | http_query | high | python
get_json get_data | request | http_body | high | python
input | - | io_input | medium | python
getenv | os | env_input | low | python
FormValue PostFormValue | Request | http_param | high | go
Get | Header | http_header | high | go
Getenv | os | env_input | low | go
ReadString ReadLine | Reader | io_input | medium | go
args | env | env_input | low | rust
read_line | stdin | io_input | medium | rust
recv receive read | Socket | network_input | medium | java python
readFile readFileSync readAllBytes | - | file_input | low | java javascript typescript
"""

SINKS = """
executeQuery executeUpdate execute addBatch | Statement | sql_injection | 0 | java
prepareStatement prepareCall nativeSQL | Connection | sql_injection | 0 | java
createQuery createNativeQuery | EntityManager | sql_injection | 0 | java
queryForObject queryForList | JdbcTemplate | sql_injection | 0 | java
execute executemany executescript | cursor | sql_injection | 0 | python
query raw | db | sql_injection | 0 | javascript typescript
Query Exec QueryRow | DB | sql_injection | 0 | go
find findOne where aggregate | collection | nosql_injection | 0 | javascript typescript python
exec | Runtime | command_injection | 0 | java
exec execSync spawn execFile | child_process | command_injection | 0 | javascript typescript
system popen | os | command_injection | 0 | python
run call Popen check_output | subprocess | command_injection | 0 | python
Command CommandContext | exec | command_injection | 0,1 | go
new arg | Command | command_injection | 0 | rust
eval | - | code_injection | 0 | javascript typescript python
Function | - | code_injection | 0 | javascript typescript
compile exec | - | code_injection | 0 | python
evaluate parseExpression | ExpressionParser | code_injection | 0 | java
File FileInputStream FileOutputStream FileReader FileWriter | - | path_traversal | 0 | java
readFile readFileSync writeFile createReadStream sendFile | fs | path_traversal | 0 | javascript typescript
open | - | path_traversal | 0 | python
Open ReadFile Create | os | path_traversal | 0 | go
print println write append | PrintWriter | xss | 0 | java
send write end render | res | xss | 0 | javascript typescript
render_template_string Markup | - | xss | 0 | python
Fprintf Fprint | fmt | xss | 1 | go
readObject readUnshared | ObjectInputStream | deserialization |  | java
loads load | pickle | deserialization | 0 | python
load | yaml | deserialization | 0 | python
unserialize deserialize | - | deserialization | 0 | javascript typescript
parse | DocumentBuilder | xxe | 0 | java
parse fromstring | etree | xxe | 0 | python
search | DirContext | ldap_injection | 0,1 | java
search_s | ldap | ldap_injection | 2 | python
evaluate compile | XPath | xpath_injection | 0 | java
openConnection openStream | URL | ssrf |  | java
get post put request urlopen | requests | ssrf | 0 | python
get post request | axios | ssrf | 0 | javascript typescript
Get Post | http | ssrf | 0 | go
sendRedirect | HttpServletResponse | open_redirect | 0 | java
redirect | - | open_redirect | 0 | javascript typescript python
info warn error debug | Logger | log_injection | 0 | java
info warning error | logging | log_injection | 0 | python
setHeader addHeader | HttpServletResponse | crlf | 1 | java
format | String | format_string | 0 | java
setAttribute putValue | HttpSession | trust_boundary | 1 | java
copyProperties populate | BeanUtils | mass_assignment | 1 | java
create complete generate | completions | prompt_injection | 0 | python javascript typescript
"""

SANITIZERS = """
escapeHtml escapeHtml4 forHtml encodeForHTML htmlEscape escape_html escapeHTML EscapeString | - | xss
encodeForSQL quote_ident escape_string escapeId | - | sql_injection
setString setInt setLong setParameter | - | sql_injection
encodeForLDAP escape_filter_chars | - | ldap_injection
encodeForURL urlencode encodeURIComponent quote | - | ssrf open_redirect crlf xss
getCanonicalPath normalize realpath basename secure_filename Clean | - | path_traversal
shlex_quote escapeshellarg quote | - | command_injection
parseInt parseLong valueOf Integer int float Number Atoi | - | sql_injection command_injection xss path_traversal code_injection
sanitize purify clean bleach | - | xss
safe_load | - | deserialization
"""


def _rows(text: str) -> list[list[str]]:
    return [[x.strip() for x in line.split("|")] for line in text.strip().splitlines()]


def sources(spark: SparkSession) -> DataFrame:
    rows = [(m, None if c == "-" else c, t, s, langs.split()) for ms, c, t, s, langs in _rows(SOURCES) for m in ms.split()]
    return spark.createDataFrame(rows, taint.SOURCE_PATTERNS)


def sinks(spark: SparkSession) -> DataFrame:
    rows = [(m, None if c == "-" else c, t, RULES[t][0], RULES[t][1], [int(x) for x in p.split(",") if x], langs.split()) for ms, c, t, p, langs in _rows(SINKS) for m in ms.split()]
    return spark.createDataFrame(rows, taint.SINK_PATTERNS)


def sanitizers(spark: SparkSession) -> DataFrame:
    rows = [(m, None if c == "-" else c, t.split()) for ms, c, t in _rows(SANITIZERS) for m in ms.split()]
    return spark.createDataFrame(rows, taint.SANITIZER_PATTERNS)


def matched(facts):
    """Facts with the sources, sinks and sanitizers that the default patterns find."""
    s = facts.spark
    f = facts.with_tables(taint_sources=taint.match_sources(facts, sources(s)), taint_sinks=taint.match_sinks(facts, sinks(s)))
    found = taint.match_sanitizers(f, sanitizers(s)).select("file", "san_ord", "type", "method", "line", "sanitizes").unionByName(taint.derived_sanitizers(f, sanitizers(s)).select("file", "san_ord", "type", "method", "line", "sanitizes"))
    return f.with_tables(taint_sanitizers=found)

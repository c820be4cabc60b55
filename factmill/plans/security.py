"""Security passes over calls and lines. Most are rows of a table: which calls or lines, in which languages, unless what."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions.text import entropy
from .findings import findings
from .registry import register

# Words that name credentials, and what keys of known services look like.
CREDENTIAL = "(?i)(pass(word|wd|phrase)?|secret|token|api_?key|credential|private_?key|auth)"
PROVIDERS = {
    "aws-access-key": "\\b(AKIA|ASIA)[0-9A-Z]{16}\\b",
    "github-token": "\\bgh[pousr]_[A-Za-z0-9]{36,}\\b",
    "google-api-key": "\\bAIza[0-9A-Za-z_-]{35}\\b",
    "slack-token": "\\bxox[abprs]-[0-9A-Za-z-]{10,}\\b",
    "stripe-key": "\\b[sr]k_live_[0-9A-Za-z]{20,}\\b",
    "private-key": "-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
    "jwt": "\\beyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{5,}",
}


@dataclass(frozen=True)
class LineRule:
    """A finding for each line that matches, of files in the languages, unless the line (or the whole file) matches what clears it."""

    rule: str
    cwe: str
    severity: str
    pattern: str
    message: str
    languages: tuple[str, ...] = ()
    unless: str = ""
    unless_file: str = ""


#: Texts in lower case of which a line has one at least if the rule's pattern can match: looking for them is much cheaper.
NEEDS = {
    "weak-hash": "md5 sha1 sha-1",
    "weak-crypto": "cipher des. desede arc4 mode_ecb rc4",
    "weak-random": "random rand.",
    "insecure-cookie": "cookie",
    "tls-verify-disabled": "verify rejectunauthorized tls_reject unverified_context invalid_certs hostname_verifier hostnameverifier",
    "jwt-verify-disabled": "jwt algorithm signature_validation parseunverified",
    "csrf-protection-disabled": "csrf abstracthttpconfigurer",
    "xml-entity-expansion": "factory etree xml.sax",
    "mass-assignment": "req. request",
    "info-disclosure-stacktrace": "stack .message traceback debug .send .json .write .end",
    "unrestricted-file-upload": "filename .name originalname",
    "insecure-deserialization-config": "anytypepermission defaulttyping autotype laissezfaire",
    "weak-password-hash": "pass bcrypt pbkdf2",
    "weak-password-encoding": "pass",
    "plaintext-password-storage": "pass",
    "cleartext-credential-transport": "http://",
    "module-side-effect": "exec eval system subprocess",
    "python-receiver-taint-format": ".format(",
    "mybatis-annotation-sql": "${",
    "predictable-temp-file": "/tmp/",
    "insecure-file-permission": "chmod",
    "unverified-package-install": "curl wget",
    "cors-wildcard-origin": "access-control-allow-origin crossorigin",
    "code-injection": "eval",
    "unsafe-deserialization": "load objectinputstream",
    "sql-string-concat": "execute query raw",
    "open-redirect": "redirect",
    "ssrf": "req. request getparameter args.get formvalue",
    "xss-response-write": "getwriter innerhtml document.write fprintf bypasssecurity",
    "rust-hardcoded-credential": "pass secret api token",
    "rust-insecure-cookie": "cookie::",
    "rust-weak-crypto-ecb": "ecb",
    "bash-weak-hash": "md5 sha1",
    "go-weak-tls-version": "version",
}

JS = ("javascript", "typescript")
RULES = [
    LineRule("weak-hash", "CWE-328", "medium", "(?i)(getInstance\\(\\s*\"(md5|sha-?1)\"|createHash\\(\\s*['\"](md5|sha1)['\"]|hashlib\\.(md5|sha1)\\(|\\bmd5\\.(New|Sum)|sha1\\.(New|Sum)|Md5::new|Sha1::new)", "A hash that no longer withstands attacks", unless="usedforsecurity\\s*=\\s*False"),
    LineRule("weak-crypto", "CWE-327", "high", "(?i)(Cipher\\.getInstance\\(\\s*\"(DES|RC4|RC2|Blowfish|DESede|AES/ECB|AES\")|createCipher(iv)?\\(\\s*['\"](des|rc4|bf|aes-\\d+-ecb)|\\bDES\\.new|ARC4\\.new|MODE_ECB|des\\.NewCipher|rc4\\.NewCipher)", "A cipher or mode that can be broken"),
    LineRule("weak-random", "CWE-330", "medium", "(\\bnew\\s+Random\\s*\\(|\\bMath\\.random\\s*\\(|\\brandom\\.(random|randint|choice|randrange)\\s*\\(|\\brand\\.(Int|Intn|Float64)\\s*\\()", "Random numbers that can be guessed", unless_file="SecureRandom|crypto/rand|secrets\\."),
    LineRule("insecure-cookie", "CWE-614", "medium", "(?i)(\\.cookie\\(\\s*['\"][^'\"]+['\"]\\s*,[^)]*\\)|set_cookie\\(|new\\s+Cookie\\()", "A cookie without secure or httpOnly", unless="(?i)secure\\s*[:=]\\s*true", unless_file="(?i)setSecure\\(\\s*true|SESSION_COOKIE_SECURE\\s*=\\s*True"),
    LineRule("tls-verify-disabled", "CWE-295", "high", "(verify\\s*=\\s*False|rejectUnauthorized\\s*:\\s*false|InsecureSkipVerify\\s*:\\s*true|NODE_TLS_REJECT_UNAUTHORIZED|_create_unverified_context|danger_accept_invalid_certs\\(\\s*true|ALLOW_ALL_HOSTNAME_VERIFIER|NoopHostnameVerifier)", "Certificates are not checked"),
    LineRule("jwt-verify-disabled", "CWE-347", "critical", "(?i)(jwt\\.decode\\([^)]*verify(_signature['\"]?)?\\s*[:=]\\s*False|algorithms?\\s*[:=]\\s*\\[?\\s*['\"]none['\"]|insecure_disable_signature_validation|ParseUnverified\\()", "A token's signature is not checked"),
    LineRule("csrf-protection-disabled", "CWE-352", "critical", "(csrf\\(\\)\\.disable\\(\\)|\\.csrf\\(\\s*\\w+\\s*->\\s*\\w+\\.disable\\(\\)|AbstractHttpConfigurer::disable|@csrf_exempt|WTF_CSRF_ENABLED\\s*=\\s*False)", "Protection against forged requests is off"),
    LineRule("xml-entity-expansion", "CWE-611", "high", "(DocumentBuilderFactory|SAXParserFactory|XMLInputFactory)\\.newInstance\\(|\\betree\\.(parse|fromstring|XML)\\(|xml\\.sax\\.parse", "XML is read with external entities", unless_file="disallow-doctype-decl|FEATURE_SECURE_PROCESSING|defusedxml|resolve_entities\\s*=\\s*False|SUPPORT_DTD"),
    LineRule("mass-assignment", "CWE-915", "high", "(Object\\.assign\\([^,]+,\\s*req\\.(body|query)|\\{\\s*\\.\\.\\.req\\.(body|query)|\\*\\*request\\.(json|form|data|POST)|\\.create\\(\\s*req\\.body\\s*\\)|BeanUtils\\.(copyProperties|populate)\\([^)]*request)", "All fields of a request are taken over"),
    LineRule("info-disclosure-stacktrace", "CWE-209", "medium", "(\\.printStackTrace\\(\\s*(response|resp|out)|res(ponse)?\\.(send|json|write|end)\\([^)]*\\b(err|error|e|ex)\\.(stack|message)|return\\s+.*traceback\\.format_exc|debug\\s*=\\s*True)", "Details of an error are shown to callers"),
    LineRule("unrestricted-file-upload", "CWE-434", "high", "(transferTo\\([^)]*getOriginalFilename|\\.save\\([^)]*\\.filename|\\.mv\\([^)]*\\.name\\b|writeFile(Sync)?\\([^)]*originalname)", "An upload is stored under the name it came with", unless_file="(?i)allowed_?ext|secure_filename|mimetype|ALLOWED"),
    LineRule("insecure-deserialization-config", "CWE-502", "high", "(AnyTypePermission|enableDefaultTyping\\(|setAutoTypeSupport\\(\\s*true|LaissezFaireSubTypeValidator)", "Any type may be deserialised", ("java",)),
    LineRule("weak-password-hash", "CWE-916", "high", "(?i)((md5|sha1|sha256|sha512)\\w*\\(?[^;]*pass(word|wd)|bcrypt\\.(hash|gensalt)\\w*\\([^)]*\\b[1-9]\\s*\\)|PBKDF2\\w*\\([^)]*\\b\\d{1,4}\\b)", "A hash that is too quick for passwords"),
    LineRule("weak-password-encoding", "CWE-261", "medium", "(?i)((base64|b64encode|btoa|hexlify|toString\\(\\s*['\"](hex|base64))[^;]*pass(word|wd)|pass(word|wd)[^;=]*=\\s*[^;]*(b64encode|btoa|encodeToString|hexlify)\\()", "A password is encoded, not hashed"),
    LineRule("plaintext-password-storage", "CWE-256", "high", "(?i)((insert|save|create|update|store|put|write)\\w*\\([^)]*\\bpass(word|wd)\\b)", "A password is stored as it is", unless="(?i)hash|bcrypt|scrypt|argon|encod", unless_file="(?i)bcrypt|scrypt|argon2|pbkdf2"),
    LineRule("cleartext-credential-transport", "CWE-523", "high", "(?i)http://(?!localhost|127\\.0\\.0\\.1)[^\\s'\"]*.*(password|token|secret|apikey)", "Credentials travel over http"),
    LineRule("module-side-effect", "CWE-829", "high", "^(exec|eval|os\\.system|subprocess\\.(run|call|Popen)|child_process\\.exec\\w*|execSync)\\s*\\(", "Importing the module runs a command", ("python", *JS)),
    LineRule("python-receiver-taint-format", "CWE-134", "medium", "(request\\.\\w+|input\\(\\)|sys\\.argv)[^=]*\\.format\\(", "The format comes from outside", ("python",)),
    LineRule("mybatis-annotation-sql", "CWE-89", "critical", "@(Select|Insert|Update|Delete)\\s*\\([^)]*\\$\\{", "SQL with text put in place", ("java",)),
    LineRule("predictable-temp-file", "CWE-377", "medium", "(=|>|>>)\\s*\"?/tmp/[A-Za-z0-9_.-]+", "A temporary file whose name can be guessed", ("bash",), unless="mktemp|\\$\\$|RANDOM"),
    LineRule("insecure-file-permission", "CWE-732", "medium", "\\bchmod\\s+(-R\\s+)?(0?777|a\\+rwx|o\\+w)|os\\.chmod\\([^,]+,\\s*0o?777", "Everyone may write"),
    LineRule("unverified-package-install", "CWE-494", "high", "(curl|wget)\\b[^|]*\\|\\s*(sudo\\s+)?(ba)?sh\\b", "What is downloaded is run unseen", ("bash",)),
    LineRule("cors-wildcard-origin", "CWE-942", "high", "Access-Control-Allow-Origin['\"]?\\s*[,:)]\\s*['\"]\\*['\"]|@CrossOrigin\\(\\s*(origins\\s*=\\s*)?\"\\*\"", "Any origin may read the answers"),
    LineRule("code-injection", "CWE-94", "critical", "\\beval\\s*\\(\\s*(req\\.|request\\.|input\\(|sys\\.argv|process\\.argv)", "Text from outside is run"),
    LineRule("unsafe-deserialization", "CWE-502", "critical", "\\b(pickle|cPickle|marshal)\\.loads?\\s*\\(|yaml\\.load\\s*\\((?![^)]*(SafeLoader|CSafeLoader))|\\bnew\\s+ObjectInputStream\\s*\\(", "Objects are made from untrusted bytes"),
    LineRule("sql-string-concat", "CWE-89", "critical", "(?i)(execute|executeQuery|query|raw|createQuery)\\s*\\(\\s*[f]?[\"'][^\"']*(select|insert|update|delete)\\b[^\"']*([\"']\\s*(\\+|%)|\\{\\w)", "SQL is put together from text"),
    LineRule("open-redirect", "CWE-601", "medium", "(sendRedirect|redirect|http\\.Redirect)\\s*\\([^)]*(req\\.|request\\.|getParameter|args\\.get|FormValue)", "The target of a redirect comes from the request"),
    LineRule("ssrf", "CWE-918", "high", "(requests\\.(get|post)|urlopen|axios\\.(get|post)|fetch|http\\.Get|new\\s+URL)\\s*\\([^)]*(req\\.|request\\.|getParameter|args\\.get|FormValue)", "The address of a request comes from a request", unless="(?i)allow"),
    LineRule("xss-response-write", "CWE-79", "high", "(getWriter\\(\\)\\.(print|println|write)\\([^)]*getParameter|innerHTML\\s*=\\s*[^;]*(location|req\\.|\\.value)|document\\.write\\([^)]*location|fmt\\.Fprintf\\(\\s*w\\s*,[^)]*FormValue|bypassSecurityTrustHtml)", "Text from outside becomes markup"),
    LineRule("rust-hardcoded-credential", "CWE-798", "high", "(?i)\\b(const|static|let)\\s+(mut\\s+)?\\w*(password|passwd|secret|api_?key|token)\\w*\\s*(:[^=]+)?=\\s*(String::from\\()?\"[^\"]{4,}\"", "A credential stands in the code", ("rust",)),
    LineRule("rust-insecure-cookie", "CWE-614", "medium", "\\bCookie::(new|build)\\s*\\(", "A cookie without secure", ("rust",), unless="\\.secure\\(\\s*true"),
    LineRule("rust-weak-crypto-ecb", "CWE-327", "high", "\\bEcb\\s*(::)?\\s*<|\\becb::(Encryptor|Decryptor)|\\bEcb(Enc|Dec)\\b", "ECB shows equal blocks as equal", ("rust",)),
    LineRule("bash-weak-hash", "CWE-328", "medium", "\\b(md5sum|sha1sum)\\b|\\bopenssl\\s+(dgst\\s+-)?(md5|sha1)\\b", "A hash that no longer withstands attacks", ("bash",)),
    LineRule("go-weak-tls-version", "CWE-327", "high", "\\b(MinVersion|MaxVersion)\\s*:\\s*tls\\.(VersionSSL30|VersionTLS10|VersionTLS11)\\b", "A version of TLS that can be broken", ("go",)),
]


def line_findings(f: Facts, rules=RULES) -> DataFrame:
    """All line rules in one pass over the lines: the matching rules of a line are an array that is exploded."""
    t = f.source_lines.join(f.files.select("file", "language"), "file")
    clear = {r.unless_file for r in rules if r.unless_file}
    if clear:
        flags = f.source_lines.groupBy("file").agg(*[F.bool_or(F.col("text").rlike(p)).alias(f"clear_{i}") for i, p in enumerate(sorted(clear))])
        t = t.join(flags, "file")
    at = {p: i for i, p in enumerate(sorted(clear))}

    def hit(r: LineRule) -> Column:
        c = F.col("text").rlike(r.pattern)
        if r.rule in NEEDS:
            c = reduce(lambda a, b: a | b, [F.col("low").contains(x) for x in NEEDS[r.rule].split()]) & c
        if r.languages:
            c = F.col("language").isin(list(r.languages)) & c
        if r.unless:
            c = c & ~F.col("text").rlike(r.unless)
        if r.unless_file:
            c = c & ~F.col(f"clear_{at[r.unless_file]}")
        level = {"low": "note", "medium": "warning"}.get(r.severity, "error")
        return F.when(c, F.struct(*[F.lit(x).alias(n) for n, x in (("rule", r.rule), ("cwe", r.cwe), ("severity", r.severity), ("level", level), ("message", r.message))]))

    every = F.filter(F.array(*map(hit, rules)), lambda x: x.isNotNull())
    t = t.where(~F.trim("text").rlike("^(//|#(?!!)|\\*)")).withColumn("low", F.lower("text")).withColumn("hit", F.explode(every))
    out = findings(t, "line-rule", "security", F.col("hit.cwe"), F.col("hit.severity"), F.col("hit.level"), F.col("hit.message"), snippet=F.trim("text"), evidence={"rule": "hit.rule"})
    rule = F.get_json_object("evidence", "$.rule")
    return out.withColumn("rule_id", rule).withColumn("pass", rule).withColumn("id", F.concat(rule, F.lit("-"), "file", F.lit("-"), F.col("line").cast("string"))).withColumn("evidence", F.lit(None).cast("string"))


def rule_findings(f: Facts, names: list[str]) -> DataFrame:
    """The rules of these names, in one pass over the lines."""
    return line_findings(f, [r for r in RULES if r.rule in names])


def _register_rules():
    for name in dict.fromkeys(r.rule for r in RULES):
        register(name, "security", together=rule_findings)(lambda f, _name=name: rule_findings(f, [_name]))


_register_rules()


def secret_candidates(lines: DataFrame) -> DataFrame:
    """file, line, kind, secret, bits: keys of known services, and quoted strings of 20 to 200 characters with high entropy.

    Base64-like strings need 4.3 bits a character and hexadecimal ones 3.5, each 0.2 less next to a name for a credential.
    """
    found = None
    for kind, pattern in PROVIDERS.items():
        own = lines.withColumn("secret", F.regexp_extract("text", f"({pattern})", 1)).where("secret != ''").select("file", "line", F.lit(kind).alias("kind"), "secret", "text")
        found = own if found is None else found.unionByName(own)
    quoted = lines.withColumn("secret", F.explode(F.regexp_extract_all("text", F.lit("[\"']([A-Za-z0-9+/=_-]{20,200})[\"']"), F.lit(1)))).select("file", "line", F.lit("high-entropy").alias("kind"), "secret", "text")
    both = found.withColumn("bits", F.lit(None).cast("double")).unionByName(quoted.withColumn("bits", F.round(entropy(F.col("secret")), 4)))
    least = F.when(F.col("secret").rlike("^[0-9a-fA-F]+$"), 3.5).otherwise(4.3) - F.when(F.col("text").rlike(CREDENTIAL), 0.2).otherwise(0.0)
    return both.where((F.col("kind") != "high-entropy") | (F.col("bits") >= least)).drop("text").distinct()


@register("scan-secrets", "security")
def scan_secrets(f: Facts) -> DataFrame:
    from .design import TEST_PATH

    s = secret_candidates(f.source_lines.where(~F.col("file").rlike(TEST_PATH)))
    return findings(s, "scan-secrets", "security", "CWE-798", "high", "error", F.format_string("A secret in the code (%s)", "kind"), fix="Take it from the environment or a vault", evidence={"kind": "kind"})


@register("security-headers", "security")
def security_headers(f: Facts) -> DataFrame:
    """Headers that a file with handlers does not write, or writes with a weak or reflected value."""
    writes = f.calls.where(F.col("method_name").isin("setHeader", "addHeader", "header", "set", "append", "Set", "Add")).join(f.call_args.where("position = 0").select("file", "call_id", F.lower("literal").alias("header")), ["file", "call_id"]).join(f.call_args.where("position = 1").select("file", "call_id", F.col("literal").alias("value"), F.col("expression").alias("value_text")), ["file", "call_id"], "left").where("header is not null")
    handlers = f.methods.where(F.coalesce(F.arrays_overlap("annotations", F.array(*[F.lit(x) for x in ("GetMapping", "PostMapping", "RequestMapping", "Get", "Post", "Controller")])), F.lit(False))).select("file").distinct()
    middleware = f.source_lines.where(F.col("text").rlike("helmet\\(|frameOptions\\(|secure_headers|Talisman\\(")).select("file").distinct()
    out = None
    for rule, header, severity, cwe in (("missing-x-frame-options", "x-frame-options", "medium", "CWE-1021"), ("missing-csp-frame-ancestors", "content-security-policy", "low", "CWE-1021")):
        has = writes.where(F.col("header") == header).select("file").distinct()
        one = findings(handlers.join(has, "file", "left_anti").join(middleware, "file", "left_anti").withColumn("line", F.lit(1)), rule, "security", cwe, severity, "note" if severity == "low" else "warning", F.lit(f"The handlers do not set {header}"), name="security-headers")
        out = one if out is None else out.unionByName(one)
    for rule, header, pattern, severity, cwe in (("x-frame-options-allow-from", "x-frame-options", "(?i)allow-from", "medium", "CWE-1021"), ("cors-wildcard-origin", "access-control-allow-origin", "^\\*$", "high", "CWE-942"), ("cors-null-origin", "access-control-allow-origin", "(?i)^null$", "high", "CWE-346"), ("cors-http-origin", "access-control-allow-origin", "^http://", "medium", "CWE-346")):
        out = out.unionByName(findings(writes.where((F.col("header") == header) & F.col("value").rlike(pattern)), rule, "security", cwe, severity, "error" if severity == "high" else "warning", F.format_string("%s is %s", F.lit(header), F.col("value")), name="security-headers"))
    reflected = writes.where((F.col("header") == "access-control-allow-origin") & F.col("value").isNull() & F.col("value_text").isNotNull())
    return out.unionByName(findings(reflected, "cors-reflected-origin", "security", "CWE-346", "high", "error", F.lit("The allowed origin is what the request says"), name="security-headers"))

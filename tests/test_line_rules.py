import re

import pytest
from pyspark.sql import functions as F

from factmill.plans.security import NEEDS, RULES, line_findings
from tests.test_passes import facts

#: A line for each rule that it must find, and one that it must leave alone.
LINES = {
    "weak-hash": ('MessageDigest.getInstance("MD5")', 'MessageDigest.getInstance("SHA-256")'),
    "weak-crypto": ('Cipher.getInstance("DES/CBC")', 'Cipher.getInstance("AES/GCM/NoPadding")'),
    "weak-random": ("new Random()", "new SecureRandomizer()"),
    "insecure-cookie": ("res.cookie('a', b)", "res.cookie('a', b, {secure: true})"),
    "tls-verify-disabled": ("requests.get(u, verify=False)", "requests.get(u, verify=True)"),
    "jwt-verify-disabled": ("jwt.decode(t, verify=False)", "jwt.decode(t, key)"),
    "csrf-protection-disabled": ("http.csrf().disable()", "http.csrf()"),
    "xml-entity-expansion": ("DocumentBuilderFactory.newInstance()", "factory.build()"),
    "mass-assignment": ("Object.assign(user, req.body)", "Object.assign(user, defaults)"),
    "info-disclosure-stacktrace": ("res.send(err.stack)", "res.send('error')"),
    "unrestricted-file-upload": ("f.save(d + upload.filename)", "f.save(path)"),
    "insecure-deserialization-config": ("x.addPermission(AnyTypePermission.ANY)", "x.addPermission(NONE)"),
    "weak-password-hash": ("md5(password)", "hash(password)"),
    "weak-password-encoding": ("b64encode(password)", "b64encode(image)"),
    "plaintext-password-storage": ("db.insert(user, password)", "db.insert(user, bcrypt(password))"),
    "cleartext-credential-transport": ("post('http://x.org/login?token=' + t)", "post('https://x.org/login?token=' + t)"),
    "module-side-effect": ("eval('x')", "    eval('x')"),
    "python-receiver-taint-format": ("request.args.format(x)", "'a'.format(request.args)"),
    "mybatis-annotation-sql": ('@Select("select * from t where a = ${a}")', '@Select("select * from t where a = #{a}")'),
    "predictable-temp-file": ("echo x > /tmp/out", "T=$(mktemp /tmp/x.XXXX)"),
    "insecure-file-permission": ("chmod 777 f", "chmod 640 f"),
    "unverified-package-install": ("curl http://x | sh", "curl -o f http://x"),
    "cors-wildcard-origin": ("h.set('Access-Control-Allow-Origin', '*')", "h.set('Access-Control-Allow-Origin', own)"),
    "code-injection": ("eval(req.body.x)", "evaluate(req.body.x)"),
    "unsafe-deserialization": ("pickle.loads(b)", "json.loads(b)"),
    "sql-string-concat": ("db.execute('select * from t where a = ' + a)", "db.execute('select * from t where a = ?', a)"),
    "open-redirect": ("res.redirect(req.query.to)", "res.redirect('/home')"),
    "ssrf": ("requests.get(request.args['u'])", "requests.get(URL)"),
    "xss-response-write": ("el.innerHTML = location.hash", "el.textContent = location.hash"),
    "rust-hardcoded-credential": ('const API_KEY: &str = "abcd1234";', 'let api_key = env::var("API_KEY");'),
    "rust-insecure-cookie": ('Cookie::new("a", b)', 'Cookie::build("a", b).secure(true)'),
    "rust-weak-crypto-ecb": ("Ecb::<Aes128, Pkcs7>::new(k)", "Cbc::<Aes128, Pkcs7>::new(k)"),
    "bash-weak-hash": ("md5sum f", "sha256sum f"),
    "go-weak-tls-version": ("MinVersion: tls.VersionTLS10", "MinVersion: tls.VersionTLS12"),
}


@pytest.mark.parametrize("language", ["java", "python", "javascript", "bash", "rust", "go"])
def test_each_rule(spark, language):
    rules = {r.rule: r for r in RULES}
    own = {n: p for n, p in LINES.items() if not rules[n].languages or language in rules[n].languages}
    flat = [(n, k, t) for n, pair in own.items() for k, t in enumerate(pair)]
    f = facts(spark, language, [t for _, _, t in flat])
    # a file's own clearing words would hide others, so each line is a file here
    f = f.with_tables(source_lines=f.source_lines.withColumn("file", F.col("line").cast("string")), files=f.source_lines.select(F.col("line").cast("string").alias("file"), F.lit(language).alias("language")))
    found = {(int(r.file), r.rule_id) for r in line_findings(f).collect()}
    for i, (n, k, t) in enumerate(flat, 1):
        assert ((i, n) in found) == (k == 0), (n, t)


def test_needs_follow_from_the_patterns():
    assert set(NEEDS) == {r.rule for r in RULES} == set(LINES)
    for n, (bad, _) in LINES.items():
        assert any(x in bad.lower() for x in NEEDS[n].split()), n
        assert any(re.search(r.pattern, bad) for r in RULES if r.rule == n), n

"""Detectors as data: two registries in order, and their patterns in Java's regex dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Detector:
    """A pattern; the first that matches a line wins among those of one `type` (secrets) or stands by itself (personal data)."""

    name: str
    regex: str
    description: str
    severity: str
    type: str
    #: lower-case strings of which any matching line holds one, whatever its case; none: not known
    needles: tuple[str, ...] = ()

    @property
    def group(self) -> int:
        """The group that holds the value: the first, or 0 where there is none."""
        return 1 if re.compile(self.regex).groups else 0


# Patterns, descriptions, severities and types, in the order that decides ties.
SECRETS = [
    Detector("aws-access-key", r"AKIA[0-9A-Z]{16}", "AWS access key ID hardcoded in source file", "HIGH", "P-01", ("akia",)),
    Detector("aws-secret-key", r'(?i)aws[_\-\s]?secret[_\-\s]?(?:access[_\-\s]?)?key\s*[=:]\s*["\']?([A-Za-z0-9/+=]{40})["\']?', "AWS secret access key hardcoded in source file", "HIGH", "P-01", ("aws",)),
    Detector("postgres-uri", r'postgres(?:ql)?://\S+:\S+@[^\s"\']+', "PostgreSQL connection string with embedded credentials", "HIGH", "P-01", ("postgres",)),
    Detector("mysql-uri", r'mysql(?:\+\w+)?://\S+:\S+@[^\s"\']+', "MySQL connection string with embedded credentials", "HIGH", "P-01", ("mysql",)),
    Detector("mongodb-uri", r'mongodb(?:\+srv)?://\S+:\S+@[^\s"\']+', "MongoDB connection string with embedded credentials", "HIGH", "P-01", ("mongodb",)),
    Detector("redis-uri", r'redis://\S+:\S+@[^\s"\']+', "Redis connection string with embedded credentials", "HIGH", "P-01", ("redis://",)),
    Detector("api-key", r'(?i)api[_\-]?key\s*[=:]\s*["\']([A-Za-z0-9\-_]{20,})["\']', "Hardcoded API key assignment detected", "HIGH", "P-01", ("api",)),
    Detector("secret-or-token", r'(?i)(?:secret|token|private[_\-]?key)\s*[=:]\s*["\']([A-Za-z0-9\-_/+=.]{16,})["\']', "Hardcoded secret or token value detected", "HIGH", "P-01", ("secret", "token", "private")),
    Detector("password", r'(?i)password\s*[=:]\s*["\']([^"\']{6,})["\']', "Hardcoded password value detected", "HIGH", "P-01", ("password",)),
    Detector("github-token", r"gh[pousr]_[A-Za-z0-9]{36,}", "GitHub personal access token detected", "HIGH", "P-01", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Detector("slack-token", r"xox[baprs]-[0-9]{10,}-[0-9]{10,}-[A-Za-z0-9]{24,}", "Slack API token detected", "HIGH", "P-01", ("xox",)),
    Detector("stripe-key", r"(?:sk|pk)_(?:live|test)_[A-Za-z0-9]{24,}", "Stripe API key (live or test) detected", "HIGH", "P-01", ("k_live_", "k_test_")),
    Detector("sendgrid-key", r"SG\.[A-Za-z0-9\-_]{22,}\.[A-Za-z0-9\-_]{43,}", "SendGrid API key detected", "HIGH", "P-01", ("sg.",)),
    Detector("twilio-sid", r"AC[a-z0-9]{32}", "Twilio Account SID detected", "HIGH", "P-01"),
    Detector("gcp-key", r"AIza[0-9A-Za-z\-_]{35}", "Google Cloud / Firebase API key detected", "HIGH", "P-01", ("aiza",)),
    Detector("private-key-block", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "Private key PEM block detected in source file", "HIGH", "P-01", ("private key-----",)),
    Detector("jwt", r"eyJ[A-Za-z0-9\-_]+\.eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+", "JWT token hardcoded in source file", "HIGH", "P-01", ("eyj",)),
    Detector("env-known-prefix", r'^(?:SECRET|TOKEN|KEY|PASSWORD|PRIVATE|CREDENTIAL|AUTH)[_A-Z0-9]*\s*=\s*["\']?(\S{8,})["\']?', "Secret value assigned in environment configuration file", "HIGH", "P-02"),
    Detector("env-known-suffix", r'^[A-Z][A-Z0-9_]*(?:TOKEN|SECRET|KEY|PASS|PWD|CREDENTIAL)\s*=\s*["\']?(\S{8,})["\']?', "Secret value assigned in environment configuration file", "HIGH", "P-02"),
    Detector("auth-header", r"(?i)(?:Authorization|X-Api-Key|Bearer):\s*([A-Za-z0-9\-_=+/]{20,})", "Authorization header with token recorded in VCR cassette", "HIGH", "P-07", ("authorization:", "x-api-key:", "bearer:")),
    Detector("basic-auth", r"Authorization:\s*Basic\s+([A-Za-z0-9+/=]{8,})", "Basic auth credentials recorded in VCR cassette file", "HIGH", "P-07", ("authorization:",)),
    Detector("ide-value", r'(?i)"(?:value|secret|token|password|key)"\s*:\s*"([A-Za-z0-9\-_=+/]{16,})"', "Secret value found inside IDE configuration artifact", "MEDIUM", "P-08", ('value"', 'secret"', 'token"', 'password"', 'key"')),
]

# Labels and patterns of personal data, in the order that decides which one a line keeps.
PERSONAL = [
    Detector("Email address", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "PII detected: Email address", "HIGH", "P-04"),
    Detector("US Social Security Number (SSN)", r"\b(?!000|666|9\d{2})\d{3}[- ]?(?!00)\d{2}[- ]?(?!0000)\d{4}\b", "PII detected: US Social Security Number (SSN)", "HIGH", "P-04"),
    Detector("Credit card number", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", "PII detected: Credit card number", "HIGH", "P-04"),
    Detector("Phone number", r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b", "PII detected: Phone number", "MEDIUM", "P-04"),
    Detector("Non-loopback IPv4 address", r"\b(?!0\.|127\.|255\.)(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "PII detected: Non-loopback IPv4 address", "MEDIUM", "P-04"),
    Detector("Passport or government ID number", r"\b[A-Z]{1,2}[0-9]{7,9}\b", "PII detected: Passport or government ID number", "HIGH", "P-04"),
    Detector("Date of birth (YYYY-MM-DD format)", r"\b(?:19|20)\d{2}[/-](?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12]\d|3[01])\b", "PII detected: Date of birth (YYYY-MM-DD format)", "MEDIUM", "P-04"),
    Detector("UK National Insurance Number", r"\b[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]\b", "PII detected: UK National Insurance Number", "HIGH", "P-04"),
    Detector("IBAN bank account number", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]{0,16})?\b", "PII detected: IBAN bank account number", "HIGH", "P-04"),
]


def build_detectors(records: list[dict]) -> list[Detector]:
    """Detectors of one's own, in order. Records whose pattern doesn't compile are left out; `skipped` tells which."""
    return [Detector(**r) for r in records if not skipped([r])]


def skipped(records: list[dict]) -> list[str]:
    """The names of the records whose pattern doesn't compile."""
    out = []
    for r in records:
        try:
            re.compile(r["regex"])
        except re.error:
            out.append(r["name"])
    return out


#: what means more in Unicode than in ASCII; other patterns are cheaper without Unicode classes
_WIDE = re.compile(r"\\[sSdDwWbB]|\(\?i\)")


def java(regex: str) -> str:
    """The pattern for Java, with Unicode classes, and the four separators that only Python counts as white space."""
    if not _WIDE.search(regex):
        return regex
    out, inside, i = [], False, 0
    while i < len(regex):
        two = regex[i : i + 2]
        if two[0] == "\\":
            if two == r"\s":
                out.append(r"\s\x1C-\x1F" if inside else r"[\s\x1C-\x1F]")
            elif two == r"\S":
                out.append(r"[^\s\x1C-\x1F]")
            else:
                out.append(two)
            i += 2
            continue
        inside = (inside or two[0] == "[") and two[0] != "]"
        out.append(two[0])
        i += 1
    return "(?U)" + "".join(out)

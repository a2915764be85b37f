"""What each log variable is called, how it is captured and how it is typed.

A server type is a name, a tokenizer for its format strings and a dictionary of
variables.  Users add their own with :func:`register_server_type`; no parsing code
is needed for that.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

ANY = "any"
DIGITS = "digits"          # zero or more
SOME_DIGITS = "digits+"    # one or more

# How a variable is expanded into further columns.
GEO = "geo"
REQUEST = "request"
TIME_LOCAL = "time_local"
TIME_ISO8601 = "time_iso8601"


@dataclass(frozen=True)
class Variable:
    column: str
    capture: str = ANY
    kind: str = "string"
    expand: str | None = None


@dataclass(frozen=True)
class ServerType:
    name: str
    token: str
    variables: dict[str, Variable]
    ignore_case: bool = False
    builtin_formats: dict[str, str] = field(default_factory=dict)

    def variable(self, token: str) -> Variable:
        if self.ignore_case:
            found = {k.lower() if "{" in k else k: v for k, v in self.variables.items()}
            token_key = token.lower() if "{" in token else token
        else:
            found, token_key = self.variables, token
        if token_key not in found:
            raise ValueError(f"unknown {self.name} log variable: {token}")
        return found[token_key]

    def tokens(self, format_str: str) -> list[tuple[str, str]]:
        """Split a format string into ('literal', text) and ('variable', name) pairs."""
        out, end = [], 0
        for m in re.finditer(self.token, format_str):
            if m.start() > end:
                out.append(("literal", format_str[end:m.start()]))
            out.append(("variable", m.group()))
            end = m.end()
        if end < len(format_str):
            out.append(("literal", format_str[end:]))
        return out


# Nginx variables and the columns they are stored under.
NGINX = ServerType(
    name="nginx",
    token=r"\$\w+",
    variables={
        "$remote_addr": Variable("ip", expand=GEO),
        "$remote_user": Variable("remote_user"),
        "$http_x_forwarded_for": Variable("proxy_ip"),
        "$request": Variable("request", expand=REQUEST),
        "$request_method": Variable("request_method"),
        "$request_uri": Variable("request_url"),
        "$request_body": Variable("request_body"),
        "$request_length": Variable("request_length", SOME_DIGITS, "bigint"),
        "$request_time": Variable("request_time", kind="double"),
        "$scheme": Variable("scheme"),
        "$server_protocol": Variable("server_protocol"),
        "$status": Variable("status_code", DIGITS, "int"),
        "$bytes_sent": Variable("bytes_sent", DIGITS, "bigint"),
        "$body_bytes_sent": Variable("body_bytes_sent", DIGITS, "bigint"),
        "$connection": Variable("connection", DIGITS, "bigint"),
        "$connection_requests": Variable("connection_requests", DIGITS, "bigint"),
        "$msec": Variable("msec", kind="decimal(16,3)"),
        "$host": Variable("host"),
        "$http_host": Variable("http_host"),
        "$http_referer": Variable("http_referer"),
        "$http_user_agent": Variable("ua"),
        "$upstream_addr": Variable("upstream_addr"),
        "$upstream_http_host": Variable("upstream_http_host"),
        "$upstream_response_time": Variable("upstream_response_time"),
        "$time_iso8601": Variable("time_iso8601", expand=TIME_ISO8601),
        "$time_local": Variable("time_local", expand=TIME_LOCAL),
    },
    # "defualt" is the spelling stored configurations refer to.
    builtin_formats={
        "defualt": (
            "$remote_addr - $remote_user [$time_local] \"$request\" "
            "$status $body_bytes_sent \"$http_referer\" \"$http_user_agent\""
        )
    },
)

# Apache directives and the columns they are stored under.  %D is in
# microseconds, nginx's $request_time in seconds; both are kept as logged.
APACHE = ServerType(
    name="apache",
    token=r"%(?:\{[\w-]+\}|[<>])?[A-Za-z]",
    variables={
        "%h": Variable("ip", expand=GEO),
        "%l": Variable("remote_logname"),
        "%u": Variable("remote_user"),
        "%t": Variable("time", expand=TIME_LOCAL),
        "%r": Variable("request", expand=REQUEST),
        "%>s": Variable("status_code", kind="int"),
        "%b": Variable("bytes_sent", kind="bigint"),
        "%D": Variable("request_time", kind="double"),
        "%m": Variable("request_method"),
        "%{Referer}i": Variable("referer"),
        "%{User-Agent}i": Variable("ua"),
        "%I": Variable("bytes_received", SOME_DIGITS, "bigint"),
        "%O": Variable("bytes_sent_with_header", SOME_DIGITS, "bigint"),
    },
    ignore_case=True,
)

_SERVER_TYPES: dict[str, ServerType] = {"nginx": NGINX, "apache": APACHE}


def register_server_type(server_type: ServerType) -> None:
    _SERVER_TYPES[server_type.name] = server_type


def server_type(name: str) -> ServerType:
    try:
        return _SERVER_TYPES[name.lower()]
    except KeyError:
        raise ValueError(
            f"unknown server type {name!r}; known: {', '.join(sorted(_SERVER_TYPES))}"
        ) from None

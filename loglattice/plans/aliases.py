"""Names for common pipelines over access logs."""

from __future__ import annotations

_REQUEST = '* - * [*] \\"* * *\\" * *'


def _parse(pattern: str, *names: str) -> str:
    return f'parse "{pattern}" as ' + ", ".join(" ".join(names).split())


ALIASES = {
    "apache": _parse(_REQUEST, "ip name timestamp method", "url protocol status contentlength"),
    "nginx": _parse(_REQUEST + ' \\"*\\"' * 3, "addr user timestamp method url", "protocol status bytes_sent", "http_referer http_user_agent gzip_ratio"),
    "k8singressnginx": _parse(
        _REQUEST + ' \\"*\\"' * 2 + " * *" + " [*]" * 2 + " *" * 5,
        "remote_addr remote_user timestamp method url", "protocol status body_bytes_sent", "http_referer http_user_agent", "request_length request_time",
        "proxy_upstream_name proxy_alternative_upstream_name", *(f"upstream_{x}" for x in ("addr", "response_length", "response_time", "status")), "req_id",
    ),
    "testmultioperator": "json | count",
}

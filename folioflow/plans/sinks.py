"""Where a digest goes: a file, or a mail server."""

from __future__ import annotations

import datetime
import logging
import smtplib
from collections.abc import Callable
from contextlib import closing
from email.message import EmailMessage
from email.policy import SMTP
from email.utils import formataddr, parseaddr
from pathlib import Path

log = logging.getLogger(__name__)


def subject(today: datetime.date | None = None, title: str = "Daily digest") -> str:
    return f"{title} {(today or datetime.date.today()):%Y/%m/%d}"


def message(html: str, sender: str, receiver: str, title: str = "Daily digest", shown_as: str = "Digest", today: datetime.date | None = None) -> EmailMessage:
    """A mail with the page as its body; names and subject are encoded by the mail policy. An address with a name of its own keeps it."""
    mail = EmailMessage(policy=SMTP)
    name, bare = parseaddr(sender)
    mail["From"] = formataddr((name or shown_as, bare))
    mail["To"] = formataddr(parseaddr(receiver))
    mail["Subject"] = subject(today, title)
    mail.set_content(html, subtype="html", charset="utf-8", cte="base64")
    return mail


def _starttls(server: str, port: int, seconds: float) -> smtplib.SMTP:
    link = smtplib.SMTP(server, port, timeout=seconds)
    try:
        link.starttls()
    except BaseException:
        link.close()
        raise
    return link


#: Ways to reach a server, by name, and whether what is sent is encrypted; they are tried in this order.
WAYS: dict[str, tuple[Callable[[str, int, float], smtplib.SMTP], bool]] = {
    "starttls": (_starttls, True),
    "ssl": (lambda server, port, seconds: smtplib.SMTP_SSL(server, port, timeout=seconds), True),
    "clear": (lambda server, port, seconds: smtplib.SMTP(server, port, timeout=seconds), False),
}


def connected(server: str, port: int, clear: bool = True, seconds: float = 60.0) -> smtplib.SMTP:
    """A connection by the first way that works. clear=False refuses to send a password without encryption."""
    errors = []
    for name, (way, secret) in WAYS.items():
        if not (secret or clear):
            continue
        try:
            return way(server, port, seconds)
        except (OSError, smtplib.SMTPException) as e:
            log.info("%s to %s:%s failed: %r", name, server, port, e)
            errors.append(f"{name}: {e!r}")
    raise ConnectionError(f"no way to {server}:{port}; " + "; ".join(errors))


def send_mail(html: str, sender: str, receiver: str, server: str, port: int, password: str, clear: bool = True, **said: object) -> None:
    """Send a page; see connected() for the ways and message() for what may be said."""
    mail = message(html, sender, receiver, **said)
    with closing(connected(server, port, clear)) as link:
        link.login(parseaddr(sender)[1], password)
        link.send_message(mail)


def write_file(html: str, path: str) -> None:
    Path(path).write_text(html, encoding="utf-8")


def log_to(level: int = logging.INFO, path: str | None = None, quiet: tuple[str, ...] = ("py4j", "urllib3", "pyspark")) -> None:
    """Send the engine's log lines to the console, or a file, in one form; loggers of libraries speak up from warnings on only."""
    target = logging.FileHandler(path, encoding="utf-8") if path else logging.StreamHandler()
    target.setFormatter(logging.Formatter("%(asctime)s %(levelname)-8s %(name)s: %(message)s"))
    ours = logging.getLogger("folioflow")
    ours.handlers[:] = [target]
    ours.setLevel(level)
    ours.propagate = False
    for name in quiet:
        logging.getLogger(name).setLevel(max(level, logging.WARNING))

"""Tags of command lines and strings by patterns, and signals of remote shells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and patterns that the tags depend on.
SHELL_TAGS = [
    ("encoded_command", r"-[Ee]nc(?:odedCommand)?\b[^\n]{0,40}\s+[A-Za-z0-9+/]{20,}={0,3}"),
    ("bypass_execution_policy", r"-ExecutionPolicy\s+[Bb]ypass|-[Ee][Pp]\s+[Bb]ypass"),
    ("download_cradle", r"(?i)(?:IEX|Invoke-Expression)[^\n]{0,80}(?:WebClient|Invoke-WebRequest|DownloadString|DownloadFile|Net\.WebClient)"),
    ("invoke_mimikatz", r"[Ii]nvoke-?[Mm]imikatz|[Mm]imikatz\.ps1|sekurlsa::"),
    ("wmi_execution", r"(?i)Invoke-WmiMethod|Get-WmiObject[^\n]{0,80}Win32_Process|Win32_Process[^\n]{0,40}Create"),
    ("ps_remoting_lateral", r"(?i)Invoke-Command\s+-ComputerName\b|Enter-PSSession\b"),
    ("lsass_access", r"(?i)lsass\.exe|MiniDump|procdump\b|sekurlsa"),
    ("reflection_load", r"(?i)\[Reflection\.Assembly\]::Load|\[System\.Reflection\.Assembly\]::Load"),
    ("amsi_bypass", r"(?i)AmsiUtils|amsiInitFailed|AmsiContext"),
    ("credential_harvest", r"(?i)\bGet-Credential\b|ConvertTo-SecureString[^\n]{0,40}-AsPlainText"),
    ("long_base64_blob", r"[A-Za-z0-9+/]{200,}={0,3}"),
]
NO_PROFILE_HIDDEN = r"(?=.*-NoP(?:rofile)?\b)(?=.*-W(?:indowStyle)?\s+[Hh]idden)"
ENCODED_PAYLOAD = r"(?i)(?:^|[\s'\"`])-(?:e|en|enc|encodedcommand)\s+['\"]?([A-Za-z0-9+/=]{20,})"
DOWNLOAD = r"(?i)(downloadstring|downloadfile|invoke-webrequest|invoke-restmethod|start-bitstransfer|net\.webclient|new-object\s+system\.net\.webclient)"
URL_OR_IP = r"(?i)(https?://|ftp://|\\\\[A-Za-z0-9_.-]+\\|(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d))"
FROM_BASE64, LONG_BASE64 = r"(?i)frombase64string", r"(?<![A-Za-z0-9+/=])([A-Za-z0-9+/=]{80,})(?![A-Za-z0-9+/=])"
REFLECTION_HELPER = r"(?i)func_get_proc_address|func_get_delegate_type|invoke-shellcode|invoke-reflectivepeinjection"
REFLECTION_API, REFLECTION_PRIMITIVE = r"(?i)getprocaddress|getdelegateforfunctionpointer", r"(?i)virtualalloc|createthread|writeprocessmemory|ntmapviewofsection|copymemory|marshal::copy"
STRING_TAGS = [
    ("url", r"https?://"),
    ("loopback_or_internal_endpoint", r"\b127\.0\.0\.1\b|\blocalhost\b|\b10\.\d+\.\d+\.\d+\b|\b172\.(1[6-9]|2\d|3[01])\.\d+\.\d+\b|\b192\.168\.\d+\.\d+\b"),
    ("powershell", r"powershell|encodedcommand|\s-enc\b|frombase64string|downloadstring|\biex\b|invoke-webrequest|invoke-expression"),
    ("credential_access", r"lsass|pwdump|mimikatz|sekurlsa|procdump|comsvcs\.dll"),
    ("remote_admin_or_lateral", r"psexec|psexesvc|wmic|wsmprovhost|winrm|evil-winrm|remoting"),
    ("suspicious_windows_path", r"c:\\\\windows\\\\temp|c:/windows/temp|\\\\temp\\\\|/temp/|appdata\\\\roaming|users\\\\public"),
    ("script_or_executable", r"\.(exe|dll|ps1|bat|cmd|vbs|js|jse|scr|sys)\b"),
    ("encoded_or_b64_marker", r"[a-z0-9+/]{80,}={0,2}"),
]
SHELL_SIGNALS = [
    ("netcat_exec_redirection", 5, r"(?i)\b(?:nc|ncat|netcat)(?:\.exe)?\b[^\n]{0,200}?(?:\s-e\b|--exec\b|--sh-exec\b)"),
    ("dev_tcp_reverse_shell", 5, r"(?i)/dev/(?:tcp|udp)/[^/\s]+/\d{1,5}"),
    ("remote_connect_flag", 4, r"(?i)(?:^|\s)(?:-s|--connect|--rhost|-r)[\s:=]+(?:\d{1,3}\.){3}\d{1,3}:\d{1,5}"),
    ("listen_port_flag", 2, r"(?i)(?:^|\s)(?:-l|-p|--listen|--lport|/l)[\s:=]+\d{1,5}\b"),
    ("remote_socket_endpoint", 2, r"(?:\d{1,3}\.){3}\d{1,3}:\d{1,5}"),
]
SHELL_CONTEXT = (
    r"(?i)\bpowershell(?:\.exe)?\b|\bpwsh(?:\.exe)?\b|\.ps1\b|\bIEX\b|Invoke-|EncodedCommand|FromBase64String|New-Object\s+Net\.WebClient|Get-Credential|Enter-PSSession|"
    r"Invoke-Command|PSReadLine|ScriptBlock|ConsoleHost|Transcript|Microsoft-Windows-PowerShell"
)
POWERSHELL = r"(?i)\b(?:powershell|pwsh)(?:\.exe)?\b"
POWERSHELL_ENCODED = r"(?i)(?:-enc(?:odedcommand)?|-ec|-e)\b\s+[A-Za-z0-9+/=]{16,}"
POWERSHELL_RUN, POWERSHELL_NET = r"(?i)(?:\bIEX\b|Invoke-Expression)", r"(?i)(?:Net\.WebClient|DownloadString|DownloadFile|DownloadData)"
STRONG_SHELLS = ["netcat_exec_redirection", "dev_tcp_reverse_shell", "encoded_powershell_oneliner", "powershell_download_cradle"]


def _named(conditions: list[tuple[str, Column]]) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions)))))


def shell_tags(text: Column) -> Column:
    """Sorted names of the techniques that a script shows; an encoded command and a download need their payload and address."""
    text = F.coalesce(text, F.lit(""))
    payload = F.regexp_extract(text, ENCODED_PAYLOAD, 1)
    more = [
        ("no_profile_hidden", text.rlike("(?di)" + NO_PROFILE_HIDDEN)),  # letter case aside; lines end at line feeds only
        ("encoded_command", (payload != "") & ~F.contains(payload, F.lit("$"))),
        ("long_base64_blob", text.rlike(FROM_BASE64) & text.rlike(LONG_BASE64)),
        ("download_cradle", text.rlike(DOWNLOAD) & text.rlike(URL_OR_IP)),
        ("reflection_load", text.rlike(REFLECTION_HELPER) | (text.rlike(REFLECTION_API) & text.rlike(REFLECTION_PRIMITIVE))),
    ]
    return _named([(n, text.rlike(p)) for n, p in SHELL_TAGS] + more)


def string_tags(text: Column) -> Column:
    """Sorted names of what a plain string mentions."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return _named([(n, low.rlike(p)) for n, p in STRING_TAGS])


def shell_signals(text: Column) -> Column:
    """Names of the signs of a remote shell in a command line."""
    text = F.coalesce(text, F.lit(""))
    scripted = text.rlike(POWERSHELL)
    more = [("encoded_powershell_oneliner", scripted & text.rlike(POWERSHELL_ENCODED)), ("powershell_download_cradle", scripted & text.rlike(POWERSHELL_RUN) & text.rlike(POWERSHELL_NET))]
    return _named([(n, text.rlike(p)) for n, _, p in SHELL_SIGNALS] + more)


def shell_points(signals: Column) -> Column:
    """Points of ``shell_signals``."""
    points = {n: p for n, p, _ in SHELL_SIGNALS} | {n: 5 for n in STRONG_SHELLS}
    table = F.create_map(*(F.lit(x) for kv in points.items() for x in kv))
    return F.aggregate(signals, F.lit(0), lambda a, s: a + table[s])


def is_strong_shell(signals: Column) -> Column:
    return F.arrays_overlap(signals, F.array(*map(F.lit, STRONG_SHELLS)))


def is_shell_shape(signals: Column) -> Column:
    """A strong sign, or a listener that also names a remote endpoint."""
    return is_strong_shell(signals) | (F.array_contains(signals, "listen_port_flag") & F.array_contains(signals, "remote_socket_endpoint"))


def _sql(pattern: str) -> str:
    return "regexp_matches({0}, '" + pattern.replace("'", "''").replace("{", "{{").replace("}", "}}") + "')"


#: The shell tags as SQL conditions over ``{0}``, for engines without look-around.
SHELL_SQL = [
    ("no_profile_hidden", _sql(r"(?i)-NoP(?:rofile)?\b[^\n]*-W(?:indowStyle)?\s+hidden|-W(?:indowStyle)?\s+hidden[^\n]*-NoP(?:rofile)?\b")),
    ("download_cradle", f"{_sql(dict(SHELL_TAGS)['download_cradle'])} OR ({_sql(DOWNLOAD)} AND {_sql(r'(?i)(https?://|ftp://|[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)')})"),
    ("encoded_command", f"{_sql(dict(SHELL_TAGS)['encoded_command'])} OR {_sql(ENCODED_PAYLOAD)}"),
    ("reflection_load", f"{_sql(dict(SHELL_TAGS)['reflection_load'])} OR {_sql(REFLECTION_HELPER)} OR ({_sql(REFLECTION_API)} AND {_sql(REFLECTION_PRIMITIVE)})"),
    *((n, _sql(p)) for n, p in SHELL_TAGS if n not in ("download_cradle", "encoded_command", "reflection_load")),
]

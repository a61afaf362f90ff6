"""Fixed values of the evidence rules: word lists, ports, event numbers and patterns that results depend on."""

TEMP_PATHS = [
    "\\temp\\", "/tmp/", "\\windows\\temp\\", "\\appdata\\local\\temp\\", "\\programdata\\", "\\users\\public\\", "\\$recycle.bin\\",
    "\\perflogs\\", "/dev/shm/", "\\downloads\\", "\\appdata\\roaming\\temp\\",
]
INSTALLER_CACHES = ["\\package cache\\", "\\windows\\installer\\"]
LOLBINS = [
    "mshta.exe", "rundll32.exe", "regsvr32.exe", "wmic.exe", "powershell.exe", "pwsh.exe", "cmd.exe", "wscript.exe", "cscript.exe",
    "certutil.exe", "msbuild.exe", "installutil.exe", "bitsadmin.exe", "mavinject.exe", "msiexec.exe",
]
SUSPICIOUS_CHILDREN = [
    "powershell", "pwsh", "cmd.exe", "wscript", "cscript", "mshta", "rundll32", "regsvr32", ".hta", ".vbs", ".js", ".ps1", ".bat", ".scr", ".pif",
]
HIDDEN_ACTIONS = [
    "-w hidden", "-windowstyle hidden", "/create", "-enc ", "-encodedcommand", "-nop", "-noprofile", "frombase64string", "downloadstring",
    "iex(", "invoke-expression", "hidden", "vbhide",
]
RWX = ["page_execute_readwrite", "rwx", "execute_readwrite", "execute_writecopy"]
PAYLOADS = ["mz_pe", "mz pe", "pe_header", "pe header", "pe_image", "shellcode", "injected_pe", "injected pe"]
HOLLOWING = [
    "unmapped", "image_mismatch", "vad_mismatch", "hollow", "hollowed", "no_backing_file", "unbacked_executable", "replaced_image",
    "process_doppel", "process_herpaderp",
]
RUN_KEYS = [
    "\\currentversion\\run", "\\currentversion\\runonce", "\\currentversion\\runservices", "\\winlogon\\shell", "\\winlogon\\userinit",
    "\\policies\\explorer\\run",
]
EXE_SUFFIXES = [".exe", ".scr", ".com", ".pif"]
NULL_CMDLINE_PROCESSES = ["system", "registry", "memcompression", "smss.exe", "csrss.exe"]
ARCHIVES = [".zip", ".rar", ".7z", ".tar", ".gz", ".tgz", ".tbz", ".tbz2", ".bz2", ".xz", ".cab", ".iso", ".ace", ".arj", ".lzh"]
INHIBIT_RECOVERY = [
    "delete shadows", "shadows delete", "shadowcopy delete", "delete catalog", "delete systemstatebackup", "recoveryenabled no",
    "bootstatuspolicy ignoreallfailures", "delete-vssshadow", "remove-vssshadow",
]
ANTI_FORENSICS = [
    "sdelete", "sdelete64", "bleachbit", "bcwipe", "eraser.exe", "eraserl.exe", "privazer", "hardwipe", "freeraser", "wipefile", "cipher /w",
    "cipher.exe /w", "fsutil usn deletejournal", "timestomp", "setmace", "wevtutil cl", "wevtutil clearev", "clear-eventlog", "clear-winevent",
    "auditpol /clear",
]
DATA_EXTENSIONS = [
    "doc", "docx", "xls", "xlsx", "ppt", "pptx", "pdf", "txt", "rtf", "csv", "jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "psd", "dwg",
    "zip", "rar", "7z", "tar", "gz", "sql", "mdb", "accdb", "pst", "ost",
]
SERVICE_SIDS = ["s-1-5-19", "s-1-5-20"]
SHELLS = ["cmd.exe", "powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe", "powershell.ex", "powershell"]
ADMIN_SHARES = ["\\c$", "/c$", "admin$", "ipc$"]
ADMIN_SHARE_EVENTS = ["5140", "5145"]
GROUP_EVENTS = ["4732", "4728", "4756"]
PRIVILEGED_GROUP = (
    r"s-1-5-32-(544|548|549|550|551)|administrators|domain admins|enterprise admins|schema admins|backup operators|account operators|server operators"
)
PRIVILEGED_DOMAIN_RIDS = ["512", "516", "518", "519", "520"]
LISTENER_PORTS = [3389, 445, 139, 135, 5985, 5986, 22, 23, 5900]
ORDINARY_PORTS = ["80", "443", "8080", "8443"]
CORE_MODULES = [
    "ntoskrnl", "ntkrnlpa", "ntkrnlmp", "ntkrnl", "win32k", "win32kbase", "win32kfull", "halmacpi", "halacpi", "hal", "fastfat", "ntfs", "acpi",
    "tcpip", "ndis", "cdfs", "fltmgr", "ksecdd", "netbt", "wmilib", "clfs", "fwpkclnt", "msrpc", "afd", "http", "volmgr", "partmgr", "disk", "mountmgr",
]
C2_FLAGS = ["c2", "command_and_control", "beacon", "malicious"]
CRADLE = (
    r"iex|invoke-expression|downloadstring|downloadfile|downloaddata|invoke-webrequest|invoke-restmethod|net\.webclient|start-bitstransfer|"
    r"download_cradle|encodedcommand|\bwget\b|\bcurl\b"
)
KNOWN_GOOD_HOSTS = (
    r"microsoft\.com|windowsupdate\.com|windows\.net|microsoftonline|office(cdn|365|apps)|msftncsi|msftconnecttest|live\.com|skype|xboxlive|"
    r"adobe\.com|armmf\.adobe|google\.com|gstatic|googleapis|googleusercontent|mozilla|firefox|vmware|chocolatey|nagios|nxlog|sysinternals|"
    r"akamai|edgesuite|cloudfront|amazonaws\.com|azureedge|azure\.com|trafficmanager|digicert|verisign|symantec|entrust|sectigo|globalsign|"
    r"letsencrypt|ocsp|crl\.|schema\.org|w3\.org|apple\.com|icloud\.com"
)
ENCODED_OR_DOWNLOAD = (
    r"-enc\b|encodedcommand|frombase64string|downloadstring|\biex\b|invoke-expression|webclient|virtualalloc|marshal|shellcode|gzipstream|base64"
)
LOLBIN_WORDS = (
    r"\b(powershell|pwsh|cmd(\.exe)?|wmic|rundll32|regsvr32|mshta|wscript|cscript|schtasks|bitsadmin|certutil|psexec|psexesvc|pwdump|procdump|"
    r"vssadmin|winrm|wsmprovhost|sc(\.exe)?)\b"
)
SENSITIVE_PRIVILEGES = [
    "sedebugprivilege", "seimpersonateprivilege", "seassignprimarytokenprivilege", "seloaddriverprivilege", "setcbprivilege",
    "secreatetokenprivilege", "sebackupprivilege", "serestoreprivilege", "setakeownershipprivilege",
]

#: Endings that look like a top domain and are none.
NON_TLD = [
    "exe", "dll", "ps1", "bat", "cmd", "vbs", "js", "hta", "scr", "sys", "tmp", "dat", "log", "txt", "xml", "json", "local", "lan", "internal", "arpa",
    "example", "test", "invalid", "localhost",
]
DRIVER_FOLDER = r"(system32|syswow64)[\\/]+(drivers|driverstore)[\\/]"
DRIVER_PATH = r"([a-z]:[\\/][^\s\"',;|<>]*?\.sys)\b"
# The scoring table's own patterns.
STAGING = (
    r"(^|[\\/])(windows[\\/]temp|temp|users[\\/]public|appdata[\\/]local[\\/]temp|programdata[\\/]staging|programdata[\\/]temp|perflogs|recycler|\$recycle\.bin)"
    r"([\\/].*)?"
)
EXECUTABLE = r"\.(exe|dll|ps1|bat|cmd|vbs|js|scr|hta|msi|lnk)\b"
ARCHIVE = r"\.(zip|rar|7z|tar|gz|tgz|tbz2?|bz2|xz|cab|iso|ace|arj|lzh|z)(\b|$)"
REMOTE_MANAGEMENT = r"\b(winrm|wsmprovhost|wmi|psexec|psexesvc|rdp|termsrv)\b"
HIGH_PERSISTENCE = (
    r"(safeboot|alternateshell|commandlineeventconsumer|eventconsumer|eventfilter|root[\\/]+subscription|currentversion[\\/]+run|runonce|winlogon|ifeo|"
    r"image file execution options)"
)
VENDOR = (
    r"(windowsupdate\.com|update\.microsoft\.com|download\.microsoft\.com|officecdn|adobe\.com|armmf\.adobe\.com|google\.com|mozilla|vmware|"
    r"puppet labs|puppet|nxlog|nagios|chocolatey|sysmon|microsoft shared|winsxs)"
)
NORMAL_SERVICE = (
    r"^(%systemroot%|\\systemroot|system32|%windir%|c:[\\/]+windows[\\/]+system32|/windows/system32)"
    r".*(\\drivers\\|/drivers/|svchost\.exe|lsass\.exe|services\.exe|alg\.exe|spoolsv\.exe|dllhost\.exe|audiodg\.exe)"
)
BENIGN_FOLDER = r"(^|/)(windows/assembly/(temp|nativeimages)|windows/winsxs|program files|program files \(x86\))/"
NOISY_PROVIDER = r"(knownfolders|security-spp|esent|diagnosis-dps|user profiles service|vss|msiinstaller|windowsupdate)"
SYSTEM_FOLDER = r"^(windows/(system32|syswow64)/|%windir%/(system32|syswow64)/|%systemroot%/(system32|syswow64)/|systemroot/(system32|syswow64)/)"
DEFAULT_SHELLS = ["explorer.exe", "userinit.exe"]
BASELINE_PROCESSES = ["system", "svchost.exe", "lsass.exe", "services.exe", "wininit.exe", "csrss.exe", "smss.exe", "explorer.exe"]
KERNEL_MODULE = (
    r"^(ntoskrnl|ntkrnlpa|ntkrnlmp|ntkrnl|win32k|halmacpi|halacpi|hal|fastfat|ntfs|acpi|tcpip|ndis|cdfs|fltmgr|ksecdd|netbt|wmilib|clfs|fwpkclnt|msrpc)"
    r"(\.sys|\.exe|\.dll)?$"
)
SERVICE_IMAGE = r"([a-z]:[\\/][^\s|,;]*\.(?:sys|exe|dll))"
SHELL_TTP = [
    "encoded_command", "long_base64_blob", "download_cradle", "no_profile_hidden", "ps_remoting_lateral", "lsass_access", "credential_harvest",
    "bypass_execution_policy", "invoke_mimikatz", "amsi_bypass", "reflection_load", "wmi_execution",
]
SEVERE_TTP = ["invoke_mimikatz", "lsass_access", "reflection_load", "amsi_bypass", "encoded_command", "download_cradle", "credential_harvest"]
META_PROCESSES = ["system", "registry", "memory compression", "memcompression", "secure system"]
HIGH_VALUE_TOOLS = [
    "vol_malfind", "vol_psxview", "vol_ldrmodules", "vol_hollowprocesses", "parse_wmi_subscription", "vol_ssdt", "vol_modscan", "vol_driverscan",
    "vol_modules", "vol_threads", "vol_handles",
]
PROGRAM_FILE = r"(?i)([^\s\\/\"';]+\.(?:exe|dll|sys|ps1|scr|bat|cmd|vbs|js|jar|msi|com))"
USER_NAME = r"^[A-Za-z0-9._$-]{1,64}$"
NO_USERS = ["", "-", "system", "local service", "network service", "anonymous", "anonymous logon"]
PSEUDO_USERS = ["default", "public", "all users", "default user", "defaultuser0"]
USER_FOLDER = r"(?i)\\Users\\([^\\]+)\\"
XML_ACCOUNT = r'<Data\s+Name="(SubjectUserName|TargetUserName|AccountName)">([^<]+)</Data>'
TOLD_ACCOUNT = r"(?i)(?:Subject\s*User\s*Name|Target\s*User\s*Name|Account\s*Name|New\s*Account\s*Name)\s*[:=]\s*([^\s\r\n,;]+)"
SHORT_NAME = r"^([A-Za-z0-9$%'_@{}!#()&^-]{1,6})~(\d+)$"

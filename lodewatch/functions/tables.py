"""Word lists, patterns, maps and limits that results depend on."""

# Fixed values. Seconds.
TIME_WINDOW, SCRIPT_WINDOW, DEDUP_WINDOW, SUPPRESS_WINDOW, STALE_WRITE = 30, 60, 60, 2, 120
# Fixed values. Temporary files: idle seconds that close a bucket, seconds that make a file long-lived, events a second of a churning directory.
TEMP_IDLE, DEEP_WATCH, CHURN = 30, 300, 30

# Fixed values. Processes too common to link events by.
GENERIC_PROCESSES = (
    "svchost.exe", "dllhost.exe", "runtimebroker.exe", "wmiprvse.exe", "conhost.exe", "rundll32.exe",
    "taskhost.exe", "taskhostw.exe", "werfault.exe", "backgroundtaskhost.exe", "sihost.exe", "ctfmon.exe",
)

# Fixed values. Script severities in ascending order.
SCRIPT_SEVERITIES = ("NONE", "INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")

# Fixed values. Script patterns in order of precedence: text, category, severity.
SCRIPT_PATTERNS = (
    ("amsiinitfailed", "AMSI_BYPASS", "CRITICAL"),
    ("amsicontext", "AMSI_BYPASS", "CRITICAL"),
    ("amsiutils", "AMSI_BYPASS", "CRITICAL"),
    ("amsi.dll", "AMSI_BYPASS", "HIGH"),
    ("setvalue($null,$true)", "AMSI_BYPASS", "CRITICAL"),
    ("bypassamsi", "AMSI_BYPASS", "CRITICAL"),
    ("invoke-reflectivepeinjection", "REFLECTIVE_LOAD", "CRITICAL"),
    ("invoke-shellcode", "REFLECTIVE_LOAD", "CRITICAL"),
    ("[reflection.assembly]::load", "REFLECTIVE_LOAD", "HIGH"),
    ("assembly::loadwithpartialname", "REFLECTIVE_LOAD", "HIGH"),
    ("loadlibrarya", "REFLECTIVE_LOAD", "MEDIUM"),
    ("iex(", "DOWNLOAD_EXEC", "HIGH"),
    ("invoke-expression", "DOWNLOAD_EXEC", "HIGH"),
    ("net.webclient", "DOWNLOAD_EXEC", "MEDIUM"),
    ("downloadstring(", "DOWNLOAD_EXEC", "HIGH"),
    ("downloadfile(", "DOWNLOAD_EXEC", "MEDIUM"),
    ("bitstransfer", "DOWNLOAD_EXEC", "MEDIUM"),
    ("wget ", "DOWNLOAD_EXEC", "LOW"),
    ("curl ", "DOWNLOAD_EXEC", "LOW"),
    ("start-bitstransfer", "DOWNLOAD_EXEC", "MEDIUM"),
    ("mimikatz", "CRED_DUMP", "CRITICAL"),
    ("sekurlsa", "CRED_DUMP", "CRITICAL"),
    ("lsadump", "CRED_DUMP", "CRITICAL"),
    ("logonpasswords", "CRED_DUMP", "CRITICAL"),
    ("wce.exe", "CRED_DUMP", "CRITICAL"),
    ("procdump", "CRED_DUMP", "HIGH"),
    ("lsass", "CRED_DUMP", "HIGH"),
    ("[char]", "OBFUSCATION", "MEDIUM"),
    ("-join(", "OBFUSCATION", "MEDIUM"),
    ("replace(',','')", "OBFUSCATION", "MEDIUM"),
    ("env:comspec", "OBFUSCATION", "MEDIUM"),
    ("-f '", "OBFUSCATION", "LOW"),
    ("invoke-obfuscation", "OBFUSCATION", "HIGH"),
    ("out-string|-", "OBFUSCATION", "MEDIUM"),
    ("-encodedcommand", "BASE64_PAYLOAD", "HIGH"),
    ("-enc ", "BASE64_PAYLOAD", "MEDIUM"),
    ("frombase64string", "BASE64_PAYLOAD", "MEDIUM"),
    ("convert::frombase64", "BASE64_PAYLOAD", "MEDIUM"),
    ("base64_decode(", "BASE64_PAYLOAD", "MEDIUM"),
    ("virtualalloc", "SHELLCODE", "HIGH"),
    ("writeprocessmemory", "SHELLCODE", "HIGH"),
    ("createthread", "SHELLCODE", "MEDIUM"),
    ("rtlmovememory", "SHELLCODE", "HIGH"),
    ("getprocaddress", "SHELLCODE", "MEDIUM"),
    ("encrypt-file", "RANSOMWARE", "CRITICAL"),
    ("aes.create()", "RANSOMWARE", "HIGH"),
    ("get-childitem -recurse", "RANSOMWARE", "MEDIUM"),
    ("vssadmin delete shadows", "RANSOMWARE", "CRITICAL"),
    ("bcdedit /set", "RANSOMWARE", "HIGH"),
    ("wbadmin delete catalog", "RANSOMWARE", "CRITICAL"),
    ("setup.py", "SUPPLY_CHAIN", "LOW"),
    ("postinstall", "SUPPLY_CHAIN", "LOW"),
    ("preinstall", "SUPPLY_CHAIN", "LOW"),
    ("install.js", "SUPPLY_CHAIN", "MEDIUM"),
    ("subprocess.popen", "SUPPLY_CHAIN", "MEDIUM"),
    ("os.system(", "SUPPLY_CHAIN", "MEDIUM"),
    ("eval(compile(", "SUPPLY_CHAIN", "HIGH"),
    ("__import__(", "SUPPLY_CHAIN", "HIGH"),
    ("regsvr32 /s /u", "LIVING_OFF_LAND", "HIGH"),
    ("mshta vbscript:", "LIVING_OFF_LAND", "HIGH"),
    ("wmic process call create", "LIVING_OFF_LAND", "HIGH"),
    ("certutil -decode", "LIVING_OFF_LAND", "HIGH"),
    ("certutil -urlcache", "LIVING_OFF_LAND", "HIGH"),
    ("msiexec /q", "LIVING_OFF_LAND", "MEDIUM"),
    ("expand-archive", "LIVING_OFF_LAND", "LOW"),
)

# Fixed values. Patterns that count as hits in an application log.
HIT_PATTERNS = (
    "invoke-expression", "iex(", "invoke-command", "start-process", "invoke-item", "shellexecute",
    "downloadstring", "downloadfile", "net.webclient", "webrequest", "invoke-webrequest", "bitsadmin",
    "certutil", "curl ", "wget ",
    "-encodedcommand", "frombase64string", "[char]", "join-string",
    "virtualalloc", "createthread", "writeprocessmemory", "reflection.assembly", "load(",
    "mimikatz", "invoke-mimikatz", "sekurlsa", "lsadump", "dpapi", "get-credential", "securestring",
    "amsiutils", "set-mppreference", "add-mppreference", "bypass", "set-executionpolicy", "unblock-file", "unrestricted",
    "new-scheduledtask", "register-scheduledtask", "hkcu:\\software\\microsoft\\windows\\currentversion\\run", "new-service",
    "get-localuser", "get-aduser", "net user", "whoami", "systeminfo", "netstat",
    "invoke-psremoting", "new-pssession", "wmiobject", "invoke-wmimethod",
)

# Fixed values. Words that set a script flag.
SCRIPT_FLAGS = {
    "credential_access": ("credential", "securestring", "mimikatz", "sekurlsa", "lsadump"),
    "amsi_bypass": ("amsiutils", "amsicontext", "amsinit", "set-mppreference"),
    "process_injection": ("virtualalloc", "writeprocessmemory", "createthread", "reflection.assembly"),
}

# Fixed values. Application layer by port.
PORT_LAYERS = {
    80: "HTTP", 8080: "HTTP", 8000: "HTTP", 443: "HTTPS_TLS", 8443: "HTTPS_TLS", 53: "DNS", 3389: "RDP",
    445: "SMB", 137: "SMB", 138: "SMB", 139: "SMB", 21: "FTP", 22: "SSH", 25: "SMTP", 587: "SMTP",
    123: "NTP", 67: "DHCP", 68: "DHCP",
}
# Fixed values. Starts of HTTP and SMTP payloads.
HTTP_STARTS = ("GET ", "POST ", "PUT ", "HEAD ", "PATCH", "DELETE ", "OPTIO", "HTTP/")
SMTP_STARTS = ("220 ", "EHLO", "HELO")

# Fixed values. Folders of the file endpoint, with the variables that the host expands.
PROTECTED_PATHS = (
    "%SystemRoot%\\System32", "%SystemRoot%\\System32\\drivers", "%SystemRoot%\\System32\\drivers\\etc", "%SystemRoot%\\SysWOW64",
    "%SystemRoot%\\System", "%SystemRoot%\\Boot", "%SystemRoot%\\Fonts", "%ProgramFiles%", "%ProgramFiles(x86)%", "%ProgramW6432%",
    "%USERPROFILE%\\Desktop", "%USERPROFILE%\\Documents", "%USERPROFILE%\\AppData\\Roaming",
)
STARTUP_PATHS = (
    "%APPDATA%\\Microsoft\\Windows\\Start Menu\\Programs\\Startup", "%ProgramData%\\Microsoft\\Windows\\Start Menu\\Programs\\Startup",
    "%SystemRoot%\\System32\\Tasks", "%SystemRoot%\\SysWOW64\\Tasks", "%SystemRoot%\\System32\\wbem\\Repository",
    "%SystemRoot%\\System32\\GroupPolicy\\Machine\\Scripts", "%SystemRoot%\\System32\\GroupPolicy\\User\\Scripts",
)
TEMP_PATHS = (
    "%SystemRoot%\\Temp", "%TEMP%", "%TMP%", "%USERPROFILE%\\AppData\\Local\\Temp",
    "%USERPROFILE%\\AppData\\Local\\Microsoft\\Windows\\INetCache", "%USERPROFILE%\\AppData\\Local\\Microsoft\\Windows\\WebCache",
    "%USERPROFILE%\\AppData\\Local\\Google\\Chrome\\User Data\\Default\\Cache", "%USERPROFILE%\\AppData\\Local\\Microsoft\\Edge\\User Data\\Default\\Cache",
    "%SystemRoot%\\Prefetch",
)

# Fixed values. Extension sets of the file endpoint.
EXECUTABLE_EXTENSIONS = (
    ".exe", ".dll", ".sys", ".drv", ".ocx", ".bat", ".cmd", ".ps1", ".psm1", ".vbs", ".vbe", ".js", ".jse", ".wsf", ".hta", ".scr",
    ".cpl", ".msi", ".com", ".pif", ".reg", ".inf", ".lnk", ".xsl", ".xslt", ".sct", ".wsc", ".application", ".jar", ".py", ".pyc", ".rb", ".pl",
)
DOCUMENT_EXTENSIONS = (
    ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".ods", ".odp", ".pdf", ".txt", ".csv", ".xml", ".json", ".yaml", ".yml",
    ".conf", ".cfg", ".toml", ".zip", ".rar", ".7z", ".gz", ".tar", ".cab", ".iso", ".img", ".pfx", ".cer", ".crt", ".pem", ".key",
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff",
)
SCRIPT_EXTENSIONS = (".ps1", ".psm1", ".vbs", ".vbe", ".js", ".jse", ".hta", ".wsf", ".sct", ".xsl", ".wsc")
LOW_PRIORITY_EXTENSIONS = (".etl", ".evtx", ".pf", ".mui", ".db-shm", ".db-wal", ".msc", ".nls")
# Fixed values. File severities in ascending order; suspicious processes, and those of them that also matter for documents.
FILE_SEVERITIES = ("INFO", "ALERT", "WARNING", "CRITICAL")
SUSPICIOUS_PROCESSES = ("powershell", "cmd.exe", "wscript", "cscript", "mshta", "rundll32", "regsvr32", "certutil", "bitsadmin")
DOCUMENT_PROCESSES = ("powershell", "cmd.exe", "wscript", "cscript")

# Fixed values. Names that only system locations should hold, and signers expected there.
SYSTEM_EXECUTABLES = (
    "svchost.exe", "lsass.exe", "csrss.exe", "winlogon.exe", "services.exe", "smss.exe", "wininit.exe", "explorer.exe", "taskhostw.exe",
    "spoolsv.exe", "dllhost.exe", "rundll32.exe", "regsvr32.exe", "msiexec.exe", "powershell.exe", "cmd.exe", "cscript.exe", "wscript.exe",
    "conhost.exe", "dwm.exe", "audiodg.exe", "fontdrvhost.exe",
)

# Fixed values. Removable media: executable extensions, bytes and deletions that are an anomaly.
USB_EXECUTABLES = (".exe", ".dll", ".scr", ".bat", ".cmd", ".ps1", ".vbs", ".js", ".msi", ".com")
USB_BYTES, USB_DELETES = 500 << 20, 50

# Fixed values. Threat severities: least score and label.
THREAT_LABELS = ((80, "CRITICAL"), (60, "HIGH"), (40, "MEDIUM"), (20, "LOW"))

# Fixed values. IPv4 networks that are not public, and single exceptions within them.
PRIVATE_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
PUBLIC_EXCEPTIONS = ("192.0.0.9", "192.0.0.10")

# Fixed values. Signers expected of files in system locations.
SYSTEM_SIGNERS = ("microsoft windows", "microsoft corporation")

# Fixed values. Script language by a part of the host application's name, first match.
LANGUAGES = (
    ("powershell", "POWERSHELL"), ("wscript", "WSCRIPT"), ("cscript", "VBSCRIPT"), ("mshta", "MSHTA"), ("jscript", "JSCRIPT"), ("node", "JAVASCRIPT"),
    ("dotnet", "DOTNET"), ("csc.exe", "DOTNET"), ("msbuild", "DOTNET"), ("python", "PYTHON"), ("cmd.exe", "BATCH"),
)

"""Fixed values.

Everything in this module is a value the results depend on (names, lists, patterns, thresholds).
Nothing here is logic; change a value only to change a result on purpose.
"""

# --- log sources, severities, attack speeds ------------------------------------------------------
AUDITD = "auditd"
AUTH_LOG = "auth_log"
CLOUDTRAIL = "cloudtrail"
COWRIE = "cowrie"
LOG_SOURCES = [AUDITD, AUTH_LOG, CLOUDTRAIL, COWRIE]

SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]

AGGRESSIVE = "aggressive"
MODERATE = "moderate"
SLOW_SCAN = "slow_scan"

# --- techniques: id, display name ----------------------------------------------------------------
TECHNIQUES = [
    ("T1110.001", "Brute Force: Password Guessing"),
    ("T1136.001", "Create Local Account"),
    ("T1003.008", "OS Credential Dumping (/etc/shadow)"),
    ("T1036", "Masquerading"),
    ("T1053.003", "Scheduled Task/Job: Cron"),
    ("T1078", "Valid Accounts (No MFA)"),
    ("T1078.001", "Valid Accounts: Root Login"),
    ("T1562.002", "Impair Defenses: Disable CloudTrail"),
    ("T1562.001", "Impair Defenses: Disable auditd"),
    ("T1087.001", "Account Discovery: Local Account"),
    ("T1082", "System Information Discovery"),
    ("T1548", "Abuse Elevation Control"),
]

# --- auth log patterns ---------------------------------------------------------------------------
AUTH_FAILED = r"Failed password for (?:invalid user )?(\S+) from ([\d.a-fA-F:]+) port (\d+)"
AUTH_ACCEPTED = r"Accepted (?:password|publickey) for (\S+) from ([\d.a-fA-F:]+) port (\d+)"
AUTH_NEW_USER = r"new user[^:]*:\s*name=(\S+?),"
AUTH_SUDO = r"(\S+)\s+:\s+TTY=\S+\s+;\s+PWD=\S+\s+;\s+USER=(\S+)\s+;\s+COMMAND=(.*)"
SYSLOG_TIME = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
ISO_TIME = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[\.\d]*[+-]\d{2}:\d{2})"

# --- audit log patterns and values ---------------------------------------------------------------
AUDIT_NODE = r"^\s*node=(\S+)"
AUDIT_ID = r"msg=audit\((\d+\.\d+):(\d+)\)"
UNSET_AUID = 4294967295
ADMIN_AUIDS = [1000]

SHADOW_KEY = "shadow_access"
SHADOW_ALLOWED_EXES = [
    "/usr/bin/passwd",
    "/usr/sbin/unix_chkpwd",
    "/usr/bin/sudo",
    "/usr/lib/x86_64-linux-gnu/security/pam_unix.so",
    "/usr/lib/openssh/sshd-session",
]
ESCALATION_KEYS = ["sudo_execution", "su_execution", "privilege_change"]
CRON_KEY = "cron_modification"
CRON_SYSCALLS = [257, 2, 82, 86]
TAMPER_KEYS = ["auditd_tamper", "auditd_rules_tamper", "syslog_tamper", "bootloader_tamper"]
SUDOERS_KEY = "sudoers_tamper"

ENUMERATION_COMMANDS = [
    "whoami", "id", "who", "w", "getent", "finger", "groups", "last", "lastlog", "users",
]
SENSITIVE_FILES = ["/etc/passwd", "/etc/group", "/etc/sudoers", "/etc/shadow"]
DISCOVERY_COMMANDS = [
    "uname", "hostname", "uptime", "ps", "top", "htop", "netstat", "ss", "arp",
    "ifconfig", "ip", "df", "mount", "env", "printenv", "find",
]

SENSITIVE_PROCESSES = [
    "sshd", "sshd-session", "sudo", "su", "passwd", "unix_chkpwd", "polkitd",
    "cron", "crond", "systemd",
    "auditd", "rsyslogd", "systemd-journald",
    "NetworkManager", "systemd-resolved",
    "dbus-daemon",
]
TRUSTED_DIRECTORIES = ["/usr/bin/", "/usr/sbin/", "/bin/", "/sbin/", "/usr/lib/", "/usr/libexec/"]
KERNEL_NAME_LENGTH = 15
KNOWN_SYMLINKS = [("sh", "/usr/bin/dash"), ("sh", "/bin/dash")]
INTERPRETER = r"^(python3(\.\d+)?|python2?(\.\d+)?|dash|bash|sh|perl|awk|ruby|node)$"

# --- accounts ------------------------------------------------------------------------------------
SUSPICIOUS_USERNAMES = [
    "root", "daemon", "sys", "bin", "admin", "administrator", "ubuntu",
    "ec2-user", "support", "service", "backup", "sysadmin",
]

# --- cloud audit ---------------------------------------------------------------------------------
TRAIL_CRITICAL_EVENTS = ["DeleteTrail", "StopLogging"]
TRAIL_HIGH_EVENTS = ["UpdateTrail", "PutEventSelectors"]

# --- honeypot ------------------------------------------------------------------------------------
POT_CONNECT = "cowrie.session.connect"
POT_CLOSED = "cowrie.session.closed"
POT_LOGIN_OK = "cowrie.login.success"
POT_LOGIN_FAILED = "cowrie.login.failed"
POT_COMMAND = "cowrie.command.input"
DOWNLOAD_TOOLS = ["wget", "curl", "nc", "ncat", "netcat"]
DOWNLOAD_TOOL = rf"\b({'|'.join(DOWNLOAD_TOOLS)})\b"
CHMOD_X = r"chmod\s+\+x"

# --- windows and thresholds ----------------------------------------------------------------------
SSH_THRESHOLD, SSH_WINDOW_SECONDS = 5, 60
SUCCESS_THRESHOLD, SUCCESS_WINDOW_SECONDS = 5, 600
ENUMERATION_THRESHOLD, ENUMERATION_WINDOW_SECONDS = 5, 120
DISCOVERY_THRESHOLD, DISCOVERY_WINDOW_SECONDS = 5, 120

# --- rule ids ------------------------------------------------------------------------------------
RULE_SSH_BRUTE_FORCE = "T1110.001"
RULE_NO_MFA = "rule_002_console_login_no_mfa"
RULE_NEW_USER = "rule_003_new_user_created"
RULE_SHADOW = "rule_004_shadow_access"
RULE_ESCALATION = "rule_005_privilege_escalation"
RULE_ROOT_LOGIN = "rule_006_root_account_login"
RULE_BRUTE_SUCCESS = "rule_007_brute_force_success"
RULE_CRON = "rule_008_cron_persistence"
RULE_TRAIL = "rule_009_cloudtrail_disabled"
RULE_AUDIT_TAMPER = "rule_010_auditd_tamper"
RULE_SUDOERS = "rule_011_sudoers_tamper"
RULE_ENUMERATION = "rule_012_account_enumeration"
RULE_DISCOVERY = "rule_013_system_discovery"
RULE_MASQUERADING = "rule_014_masquerading"
RULE_HONEYPOT_LOGIN = "rule_015_cowrie_login"

# --- Sigma filter values -------------------------------------------------------------------------
SIGMA_FAILED_TEXTS = ["Failed password", "Invalid user"]
SIGMA_NEW_USER_TEXT = "new user added"
SIGMA_ACCEPTED_TEXT = "Accepted password"
SIGMA_ENUMERATION_SUFFIXES = ["whoami", "id", "who", "getent", "finger"]
SIGMA_DISCOVERY_SUFFIXES = [
    "uname", "hostname", "uptime", "ps", "netstat", "ss", "ifconfig", "ip", "df", "env", "find",
]
SIGMA_TAMPER_KEY = "auditd_tamper"

import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from emberwatch import constants as K  # noqa: E402
from emberwatch import schemas  # noqa: E402
from emberwatch.session import local_session  # noqa: E402
from events import table  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def auth(spark):
    return lambda *rows: table(
        spark, schemas.AUTH_EVENT, {"source": K.AUTH_LOG, "hostname": "h", "process": "sshd"}, rows
    )


@pytest.fixture
def audit(spark):
    base = {
        "source": K.AUDITD, "auid": 1000, "uid": 0, "euid": 0, "pid": 1234, "ppid": 0,
        "comm": "python3", "exe": "/usr/bin/python3", "success": True, "record_type": "SYSCALL",
    }
    return lambda *rows: table(spark, schemas.AUDIT_EVENT, base, rows)


@pytest.fixture
def cloud(spark):
    base = {
        "source": K.CLOUDTRAIL, "event_name": "ConsoleLogin", "aws_region": "us-east-1",
        "source_ip": "203.0.113.5", "actor_username": "buddy", "actor_type": "IAMUser",
        "session_mfa": "false", "mfa_authenticated": False, "console_login": "Success",
    }
    return lambda *rows: table(spark, schemas.CLOUD_EVENT, base, rows)


@pytest.fixture
def honeypot(spark):
    base = {"source": K.COWRIE, "session_id": "s1", "src_ip": "45.33.32.156"}
    return lambda *rows: table(spark, schemas.HONEYPOT_EVENT, base, rows)


@pytest.fixture
def lines(spark):
    return lambda *values: spark.createDataFrame(list(enumerate(values)), "seq BIGINT, value STRING")

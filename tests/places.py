"""Where the repository and the test tables are (a module of its own: every test folder has a ``conftest``)."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF001 = "/root/testdata/sf0.001"

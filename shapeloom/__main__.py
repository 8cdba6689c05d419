"""``python -m shapeloom``."""

import sys

from .cli import main

sys.exit(main())

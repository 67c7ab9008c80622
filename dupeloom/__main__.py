"""Entry of python -m dupeloom."""

import sys

from .cli import main

sys.exit(main())

"""python -m docketry"""

import sys

from docketry.cli import main

sys.exit(main())

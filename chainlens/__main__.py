"""``python -m chainlens <job> ...`` (see :mod:`chainlens.jobs`)."""

import sys

from chainlens.jobs import main

sys.exit(main())

import sys

from murmuration.cli import main

sys.exit(main())

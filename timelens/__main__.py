import sys

from timelens.cli import main

sys.exit(main())

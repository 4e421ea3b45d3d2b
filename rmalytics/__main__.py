import sys

from rmalytics.cli import main

sys.exit(main())

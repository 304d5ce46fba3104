"""The ellipsoid of all known systems, and the series that go with it."""

from __future__ import annotations

import math

# WGS84. GRS80 is taken for the same: their half axes differ by a tenth of a millimetre.
A_AXIS = 6378137.0
FLATTENING = 1 / 298.257223563

N = FLATTENING / (2 - FLATTENING)
E2 = 2 * math.sqrt(N) / (1 + N)  # the eccentricity
RECTIFYING = A_AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
# Published series of Krueger in the third flattening, to its third power.
ALPHA = [N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240]
BETA = [N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480]
#: Conformal to geodetic latitude.
DELTA = [2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15]
#: Authalic to geodetic latitude.
GAMMA = [4 * N / 3 + 4 * N**2 / 45 - 16 * N**3 / 35, 46 * N**2 / 45 + 152 * N**3 / 945, 3044 * N**3 / 2835]

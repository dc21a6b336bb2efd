"""Analytics on narrow matrices: very many rows, few numeric columns."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Block kernels run inside Python workers. Pickled by value they travel with
# their tasks, and executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from narrowmat.functions.kernels import ColumnSum, GramSum, Kernel, QRBlocks
from narrowmat.operators.basis import column_basis
from narrowmat.operators.blocked import blocked_product
from narrowmat.operators.check import (
    check_triu_ones, compare_factors, normalize_signs, relative_difference,
)
from narrowmat.operators.direct import DirectQR, direct_qr
from narrowmat.operators.factor import (
    cholesky_qr, collect_factor, factor_frame, gram, tsqr,
)
from narrowmat.operators.generate import gen_matrix, mix_rows
from narrowmat.operators.images import image_pca, image_regression, rgb_sums, to_gray
from narrowmat.operators.pca import center_rows, pca
from narrowmat.operators.profile import profile_values
from narrowmat.operators.regress import least_squares
from narrowmat.operators.stats import (
    col_sums, duplicate_keys, matrix_shape, peek, row_widths, word_count,
)
from narrowmat.operators.svd import (
    project, svd, svd_left, top_components, variance_share,
)
from narrowmat.plans.reduce import block_reduce
from narrowmat.sources.fixed import read_fixed, write_fixed
from narrowmat.sources.tables import (
    as_labelled, as_matrix, default_output, pack_rows, replicate, save,
    validate_matrix, with_first_keys, with_random_keys,
)
from narrowmat.sources.text import (
    format_rows, read_text_matrix, split_bytes_for, split_session, write_factors,
    write_labelled, write_text_matrix,
)

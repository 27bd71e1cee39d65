"""The library in one place."""

from meltfield.operators.mask import dense, dense_field, porosity
from meltfield.operators.morphology import boundary_cells, compute_morphology, labels, porous_from_field, region_table
from meltfield.operators.spectral import compute_spectral_components, create_melt_pool
from meltfield.plans.pipeline import RunConfig, compute_porosity, run
from meltfield.schema import GridSpec, MeltPoolSpec
from meltfield.sinks.text import write_layers, write_morphology
from meltfield.sinks.vti import read_vtk, write_vtk
from meltfield.sources.grid import create_grid, voxels
from meltfield.sources.hatch import ScanPathBuilder, ScanStrategy, create_path_vectors
from meltfield.sources.scan import read_scan_path
from meltfield.sources.series import read_data
from meltfield.sources.synthetic import MeltPoolFilter


def visualize(path: str, opacity: float = 1.0) -> None:
    """Shows a raster's pore voxels that have a free face, as cubes, if the optional viewer is installed."""
    try:
        import pyvista
    except ImportError:
        raise RuntimeError("visualize needs pyvista; boundary_cells() gives the surface cells as a table") from None
    import numpy as np

    grid, field = read_vtk(path)
    solid = np.pad(field != 0, 1)
    core = np.logical_and.reduce([np.roll(solid, step, axis) for axis in range(3) for step in (-1, 1)])
    cells = np.argwhere((solid & ~core)[1:-1, 1:-1, 1:-1]) * grid.resolution + np.array(grid.origin)
    cube = pyvista.Cube(x_length=grid.resolution, y_length=grid.resolution, z_length=grid.resolution)
    pyvista.PolyData(cells).glyph(geom=cube, scale=False, orient=False).plot(opacity=opacity, show_grid=True)


__all__ = [
    "GridSpec", "MeltPoolFilter", "MeltPoolSpec", "RunConfig", "ScanPathBuilder", "ScanStrategy", "boundary_cells", "compute_morphology", "compute_porosity",
    "compute_spectral_components", "create_grid", "create_melt_pool", "create_path_vectors", "dense", "dense_field", "labels", "porosity", "porous_from_field", "read_data",
    "read_scan_path", "read_vtk", "region_table", "run", "visualize", "voxels", "write_layers", "write_morphology", "write_vtk",
]

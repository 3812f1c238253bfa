"""Connected components of links between documents or vectors."""

from plumbline.operators.components import connected_components as connected_components

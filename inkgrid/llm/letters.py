"""Letters of different scripts that are drawn alike: one table for all operators."""

from __future__ import annotations

# Letters that are drawn alike, one class each, the Latin letter first.
SAME_LETTERS = """
aаα AАΑᎪⲀꓮ BВΒᏴⲂꓐ cсⲥ CСᏟⲤꓚ DᎠꓓ eе EЕΕᎬꓰ FꓝϜ gɡց GᏀꓖ hһհ HНΗᎻⲎꓧ iіιⲓ IІΙⲒꓲ jјϳյ JЈᎫꓙ KКΚᏦⲔꓗ lӏ LᏞꓡ MМΜᎷⲘꓟ nո NΝⲚꓠ
oоοօⲟ OОΟՕⲞꓳ pрρⲣ PРΡᏢⲢꓑ qԛզ QԚ RᎡꓣ sѕ SЅᏚՏꓢ TТΤᎢⲦꓔ uυս UՍꓴ vνѵ VᏙѴꓦ wԝ WԜᎳꓪ xхχ XХΧⲬꓫ yу YУΥⲨꓬ ZΖᏃꓜ
"""

#: Code point of a look-alike -> the Latin letter.
TO_LATIN = {ord(c): cls[0] for cls in SAME_LETTERS.split() for c in cls[1:]}

"""Pattern tables of descriptors, keys and alerts."""

# Atom types with their contribution to logP and to molar refractivity; the first pattern that matches an atom counts.
ATOM_TYPES = [
    ('C1', '[CH4]', 0.1441, 2.503),
    ('C1', '[CH3]C', 0.1441, 2.503),
    ('C1', '[CH2](C)C', 0.1441, 2.503),
    ('C2', '[CH](C)(C)C', 0.0, 2.433),
    ('C2', '[C](C)(C)(C)C', 0.0, 2.433),
    ('C3', '[CH3][N,O,P,S,F,Cl,Br,I]', -0.2035, 2.753),
    ('C3', '[CH2X4]([N,O,P,S,F,Cl,Br,I])[A;!#1]', -0.2035, 2.753),
    ('C4', '[CH1X4]([N,O,P,S,F,Cl,Br,I])([A;!#1])[A;!#1]', -0.2051, 2.731),
    ('C4', '[CH0X4]([N,O,P,S,F,Cl,Br,I])([A;!#1])([A;!#1])[A;!#1]', -0.2051, 2.731),
    ('C5', '[C]=[!C;A;!#1]', -0.2783, 5.007),
    ('C6', '[CH2]=C', 0.1551, 3.513),
    ('C6', '[CH1](=C)[A;!#1]', 0.1551, 3.513),
    ('C6', '[CH0](=C)([A;!#1])[A;!#1]', 0.1551, 3.513),
    ('C6', '[C](=C)=C', 0.1551, 3.513),
    ('C7', '[CX2]#[A;!#1]', 0.0017, 3.888),
    ('C8', '[CH3]c', 0.08452, 2.464),
    ('C9', '[CH3]a', -0.1444, 2.412),
    ('C10', '[CH2X4]a', -0.0516, 2.488),
    ('C11', '[CHX4]a', 0.1193, 2.582),
    ('C12', '[CH0X4]a', -0.0967, 2.576),
    ('C13', '[cH0]-[A;!C;!N;!O;!S;!F;!Cl;!Br;!I;!#1]', -0.5443, 4.041),
    ('C14', '[c][#9]', 0.0, 3.257),
    ('C15', '[c][#17]', 0.245, 3.564),
    ('C16', '[c][#35]', 0.198, 3.18),
    ('C17', '[c][#53]', 0.0, 3.104),
    ('C18', '[cH]', 0.1581, 3.35),
    ('C19', '[c](:a)(:a):a', 0.2955, 4.346),
    ('C20', '[c](:a)(:a)-a', 0.2713, 3.904),
    ('C21', '[c](:a)(:a)-C', 0.136, 3.509),
    ('C22', '[c](:a)(:a)-N', 0.4619, 4.067),
    ('C23', '[c](:a)(:a)-O', 0.5437, 3.853),
    ('C24', '[c](:a)(:a)-S', 0.1893, 2.673),
    ('C25', '[c](:a)(:a)=[C,N,O]', -0.8186, 3.135),
    ('C26', '[C](=C)(a)[A;!#1]', 0.264, 4.305),
    ('C26', '[C](=C)(c)a', 0.264, 4.305),
    ('C26', '[CH1](=C)a', 0.264, 4.305),
    ('C26', '[C]=c', 0.264, 4.305),
    ('C27', '[CX4][A;!C;!N;!O;!P;!S;!F;!Cl;!Br;!I;!#1]', 0.2148, 2.693),
    ('CS', '[#6]', 0.08129, 3.243),
    ('H1', '[#1][#6,#1]', 0.123, 1.057),
    ('H2', '[#1]O[CX4,c]', -0.2677, 1.395),
    ('H2', '[#1]O[!C;!N;!O;!S]', -0.2677, 1.395),
    ('H2', '[#1][!C;!N;!O]', -0.2677, 1.395),
    ('H3', '[#1][#7]', 0.2142, 0.9627),
    ('H3', '[#1]O[#7]', 0.2142, 0.9627),
    ('H4', '[#1]OC=[#6,#7,O,S]', 0.298, 1.805),
    ('H4', '[#1]O[O,S]', 0.298, 1.805),
    ('HS', '[#1]', 0.1125, 1.112),
    ('N1', '[NH2+0][A;!#1]', -1.019, 2.262),
    ('N2', '[NH+0]([A;!#1])[A;!#1]', -0.7096, 2.173),
    ('N3', '[NH2+0]a', -1.027, 2.827),
    ('N4', '[NH1+0]([!#1;A,a])a', -0.5188, 3.0),
    ('N5', '[NH+0]=[!#1;A,a]', 0.08387, 1.757),
    ('N6', '[N+0](=[!#1;A,a])[!#1;A,a]', 0.1836, 2.428),
    ('N7', '[N+0]([A;!#1])([A;!#1])[A;!#1]', -0.3187, 1.839),
    ('N8', '[N+0](a)([!#1;A,a])[A;!#1]', -0.4458, 2.819),
    ('N8', '[N+0](a)(a)a', -0.4458, 2.819),
    ('N9', '[N+0]#[A;!#1]', 0.01508, 1.725),
    ('N10', '[NH3,NH2,NH;+,+2,+3]', -1.95, 0.0),
    ('N11', '[n+0]', -0.3239, 2.202),
    ('N12', '[n;+,+2,+3]', -1.119, 0.0),
    ('N13', '[NH0;+,+2,+3]([A;!#1])([A;!#1])([A;!#1])[A;!#1]', -0.3396, 0.2604),
    ('N13', '[NH0;+,+2,+3](=[A;!#1])([A;!#1])[!#1;A,a]', -0.3396, 0.2604),
    ('N13', '[NH0;+,+2,+3](=[#6])=[#7]', -0.3396, 0.2604),
    ('N14', '[N;+,+2,+3]#[A;!#1]', 0.2887, 3.359),
    ('N14', '[N;-,-2,-3]', 0.2887, 3.359),
    ('N14', '[N;+,+2,+3](=[N;-,-2,-3])=N', 0.2887, 3.359),
    ('NS', '[#7]', -0.4806, 2.134),
    ('O1', '[o]', 0.1552, 1.08),
    ('O2', '[OH,OH2]', -0.2893, 0.8238),
    ('O3', '[O]([A;!#1])[A;!#1]', -0.0684, 1.085),
    ('O4', '[O](a)[!#1;A,a]', -0.4195, 1.182),
    ('O5', '[O]=[#7,#8]', 0.0335, 3.367),
    ('O5', '[OX1;-,-2,-3][#7]', 0.0335, 3.367),
    ('O6', '[OX1;-,-2,-2][#16]', -0.3339, 0.7774),
    ('O6', '[O;-0]=[#16;-0]', -0.3339, 0.7774),
    ('O12', '[O-]C(=O)', -1.326, 0.0),
    ('O7', '[OX1;-,-2,-3][!#1;!N;!S]', -1.189, 0.0),
    ('O8', '[O]=c', 0.1788, 3.135),
    ('O9', '[O]=[CH]C', -0.1526, 0.0),
    ('O9', '[O]=C(C)([A;!#1])', -0.1526, 0.0),
    ('O9', '[O]=[CH][N,O]', -0.1526, 0.0),
    ('O9', '[O]=[CH2]', -0.1526, 0.0),
    ('O9', '[O]=[CX2]=O', -0.1526, 0.0),
    ('O10', '[O]=[CH]c', 0.1129, 0.2215),
    ('O10', '[O]=C([C,c])[a;!#1]', 0.1129, 0.2215),
    ('O10', '[O]=C(c)[A;!#1]', 0.1129, 0.2215),
    ('O11', '[O]=C([!#1;!#6])[!#1;!#6]', 0.4833, 0.389),
    ('OS', '[#8]', -0.1188, 0.6865),
    ('F', '[#9-0]', 0.4202, 1.108),
    ('Cl', '[#17-0]', 0.6895, 5.853),
    ('Br', '[#35-0]', 0.8456, 8.927),
    ('I', '[#53-0]', 0.8857, 14.02),
    ('Hal', '[#9,#17,#35,#53;-]', -2.996, 0.0),
    ('Hal', '[#53;+,+2,+3]', -2.996, 0.0),
    ('Hal', '[+;#3,#11,#19,#37,#55]', -2.996, 0.0),
    ('P', '[#15]', 0.8612, 6.92),
    ('S2', '[S;-,-2,-3,-4,+1,+2,+3,+5,+6]', -0.0024, 7.365),
    ('S2', '[S-0]=[N,O,P,S]', -0.0024, 7.365),
    ('S1', '[S;A]', 0.6482, 7.591),
    ('S3', '[s;a]', 0.6237, 6.691),
    ('Me1', '[#3,#11,#19,#37,#55]', -0.3808, 5.754),
    ('Me1', '[#4,#12,#20,#38,#56]', -0.3808, 5.754),
    ('Me1', '[#5,#13,#31,#49,#81]', -0.3808, 5.754),
    ('Me1', '[#14,#32,#50,#82]', -0.3808, 5.754),
    ('Me1', '[#33,#51,#83]', -0.3808, 5.754),
    ('Me1', '[#34,#52,#84]', -0.3808, 5.754),
    ('Me2', '[#21,#22,#23,#24,#25,#26,#27,#28,#29,#30]', -0.0025, 0.0),
    ('Me2', '[#39,#40,#41,#42,#43,#44,#45,#46,#47,#48]', -0.0025, 0.0),
    ('Me2', '[#72,#73,#74,#75,#76,#77,#78,#79,#80]', -0.0025, 0.0),
]

# Structural keys set by a pattern that occurs.
PRESENCE_KEYS = [
    (8, '[!#6!#1]1~*~*~*~1'),
    (11, '*1~*~*~*~1'),
    (13, '[#8]~[#7](~[#6])~[#6]'),
    (14, '[#16]-[#16]'),
    (15, '[#8]~[#6](~[#8])~[#8]'),
    (16, '[!#6!#1]1~*~*~1'),
    (17, '[#6]#[#6]'),
    (19, '*1~*~*~*~*~*~*~1'),
    (20, '[#14]'),
    (21, '[#6]=[#6](~[!#6!#1])~[!#6!#1]'),
    (22, '*1~*~*~1'),
    (23, '[#7]~[#6](~[#8])~[#8]'),
    (24, '[#7]-[#8]'),
    (25, '[#7]~[#6](~[#7])~[#7]'),
    (26, '[#6]=@[#6](@*)@*'),
    (28, '[!#6!#1]~[CH2]~[!#6!#1]'),
    (30, '[#6]~[!#6!#1](~[#6])(~[#6])~*'),
    (31, '[!#6!#1]~[F,Cl,Br,I]'),
    (32, '[#6]~[#16]~[#7]'),
    (33, '[#7]~[#16]'),
    (34, '[CH2]=*'),
    (36, '[#16R]'),
    (37, '[#7]~[#6](~[#8])~[#7]'),
    (38, '[#7]~[#6](~[#6])~[#7]'),
    (39, '[#8]~[#16](~[#8])~[#8]'),
    (40, '[#16]-[#8]'),
    (41, '[#6]#[#7]'),
    (43, '[!#6!#1!H0]~*~[!#6!#1!H0]'),
    (44, '[!#1;!#6;!#7;!#8;!#9;!#14;!#15;!#16;!#17;!#35;!#53]'),
    (45, '[#6]=[#6]~[#7]'),
    (47, '[#16]~*~[#7]'),
    (48, '[#8]~[!#6!#1](~[#8])~[#8]'),
    (49, '[!+0]'),
    (50, '[#6]=[#6](~[#6])~[#6]'),
    (51, '[#6]~[#16]~[#8]'),
    (52, '[#7]~[#7]'),
    (53, '[!#6!#1!H0]~*~*~*~[!#6!#1!H0]'),
    (54, '[!#6!#1!H0]~*~*~[!#6!#1!H0]'),
    (55, '[#8]~[#16]~[#8]'),
    (56, '[#8]~[#7](~[#8])~[#6]'),
    (57, '[#8R]'),
    (58, '[!#6!#1]~[#16]~[!#6!#1]'),
    (59, '[#16]!:*:*'),
    (60, '[#16]=[#8]'),
    (61, '*~[#16](~*)~*'),
    (62, '*@*!@*@*'),
    (63, '[#7]=[#8]'),
    (64, '*@*!@[#16]'),
    (65, 'c:n'),
    (66, '[#6]~[#6](~[#6])(~[#6])~*'),
    (67, '[!#6!#1]~[#16]'),
    (68, '[!#6!#1!H0]~[!#6!#1!H0]'),
    (69, '[!#6!#1]~[!#6!#1!H0]'),
    (70, '[!#6!#1]~[#7]~[!#6!#1]'),
    (71, '[#7]~[#8]'),
    (72, '[#8]~*~*~[#8]'),
    (73, '[#16]=*'),
    (74, '[CH3]~*~[CH3]'),
    (75, '*!@[#7]@*'),
    (76, '[#6]=[#6](~*)~*'),
    (77, '[#7]~*~[#7]'),
    (78, '[#6]=[#7]'),
    (79, '[#7]~*~*~[#7]'),
    (80, '[#7]~*~*~*~[#7]'),
    (81, '[#16]~*(~*)~*'),
    (82, '*~[CH2]~[!#6!#1!H0]'),
    (83, '[!#6!#1]1~*~*~*~*~1'),
    (84, '[NH2]'),
    (85, '[#6]~[#7](~[#6])~[#6]'),
    (86, '[C;H2,H3][!#6!#1][C;H2,H3]'),
    (87, '[F,Cl,Br,I]!@*@*'),
    (89, '[#8]~*~*~*~[#8]'),
    (90, '[$([!#6!#1!H0]~*~*~[CH2]~*),$([!#6!#1!H0R]1@[R]@[R]@[CH2R]1),$([!#6!#1!H0]~[R]1@[R]@[CH2R]1)]'),
    (91, '[$([!#6!#1!H0]~*~*~*~[CH2]~*),$([!#6!#1!H0R]1@[R]@[R]@[R]@[CH2R]1),$([!#6!#1!H0]~[R]1@[R]@[R]@[CH2R]1),$([!#6!#1!H0]~*~[R]1@[R]@[CH2R]1)]'),
    (92, '[#8]~[#6](~[#7])~[#6]'),
    (93, '[!#6!#1]~[CH3]'),
    (94, '[!#6!#1]~[#7]'),
    (95, '[#7]~*~*~[#8]'),
    (96, '*1~*~*~*~*~1'),
    (97, '[#7]~*~*~*~[#8]'),
    (98, '[!#6!#1]1~*~*~*~*~*~1'),
    (99, '[#6]=[#6]'),
    (100, '*~[CH2]~[#7]'),
    (101, '[$([R]1@[R]@[R]@[R]@[R]@[R]@[R]@[R]@1),$([R]1@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@1),$([R]1@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@1),$([R]1@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@1),$([R]1@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@1),$([R]1@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@1),$([R]1@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@1)]'),
    (102, '[!#6!#1]~[#8]'),
    (104, '[!#6!#1!H0]~*~[CH2]~*'),
    (105, '*@*(@*)@*'),
    (106, '[!#6!#1]~*(~[!#6!#1])~[!#6!#1]'),
    (107, '[F,Cl,Br,I]~*(~*)~*'),
    (108, '[CH3]~*~*~*~[CH2]~*'),
    (109, '*~[CH2]~[#8]'),
    (110, '[#7]~[#6]~[#8]'),
    (111, '[#7]~*~[CH2]~*'),
    (112, '*~*(~*)(~*)~*'),
    (113, '[#8]!:*:*'),
    (114, '[CH3]~[CH2]~*'),
    (115, '[CH3]~*~[CH2]~*'),
    (116, '[$([CH3]~*~*~[CH2]~*),$([CH3]~*1~*~[CH2]1)]'),
    (117, '[#7]~*~[#8]'),
    (119, '[#7]=*'),
    (121, '[#7R]'),
    (122, '*~[#7](~*)~*'),
    (123, '[#8]~[#6]~[#8]'),
    (126, '*!@[#8]!@*'),
    (128, '[$(*~[CH2]~*~*~*~[CH2]~*),$([R]1@[CH2R]@[R]@[R]@[R]@[CH2R]1),$(*~[CH2]~[R]1@[R]@[R]@[CH2R]1),$(*~[CH2]~*~[R]1@[R]@[CH2R]1)]'),
    (129, '[$(*~[CH2]~*~*~[CH2]~*),$([R]1@[CH2]@[R]@[R]@[CH2R]1),$(*~[CH2]~[R]1@[R]@[CH2R]1)]'),
    (132, '[#8]~*~[CH2]~*'),
    (133, '*@*!@[#7]'),
    (135, '[#7]!:*:*'),
    (137, '[!C!cR]'),
    (139, '[O!H0]'),
    (144, '*!:*:*!:*'),
    (147, '[$(*~[CH2]~[CH2]~*),$([R]1@[CH2R]@[CH2R]1)]'),
    (148, '*~[!#6!#1](~*)~*'),
    (150, '*!@*@*!@*'),
    (151, '[#7!H0]'),
    (152, '[#8]~[#6](~[#6])~[#6]'),
    (154, '[#6]=[#8]'),
    (155, '*!@[CH2]!@*'),
    (156, '[#7]~*(~*)~*'),
    (157, '[#6]-[#8]'),
    (158, '[#6]-[#7]'),
    (162, 'a'),
    (165, '[R]'),
]

# Structural keys set where a pattern occurs more often than a number; (number, key).
COUNT_KEYS = [
    ('[$(*~[CH2]~[CH2]~*),$(*1~[CH2]~[CH2]1)]', [(1, 118)]),
    ('[!#6R]', [(1, 120)]),
    ('[!#6!#1]~[!#6!#1]', [(0, 124), (1, 130)]),
    ('*@*!@[#8]', [(1, 127), (0, 143)]),
    ('[!#6!#1!H0]', [(1, 131)]),
    ('[#8]=*', [(1, 136)]),
    ('[!#6!#1]~[CH2]~*', [(1, 138), (0, 153)]),
    ('[#8]', [(3, 140), (2, 146), (1, 159), (0, 164)]),
    ('[CH3]', [(2, 141)]),
    ('[#7]', [(1, 142), (0, 161)]),
    ('*1~*~*~*~*~*~1', [(1, 145), (0, 163)]),
    ('[C;H3,H4]', [(1, 149), (0, 160)]),
]

# Acceptor patterns of the desirability score.
ACCEPTORS = [
    '[oH0;X2]',
    '[OH1;X2;v2]',
    '[OH0;X2;v2]',
    '[OH0;X1;v2]',
    '[O-;X1]',
    '[SH0;X2;v2]',
    '[SH0;X1;v2]',
    '[S-;X1]',
    '[nH0;X2]',
    '[NH0;X1;v3]',
    '[$([N;+0;X3;v3]);!$(N[C,S]=O)]',
]

# Fixed value.
DONOR = '[N&!H0&v3,N&!H0&+1&v4,O&H1&+0,S&H1&+0,n&H1&+0]'

# Fixed value.
ALIPHATIC_RING = '[$([A;R][!a])]'

# Fixed value.
ROTATABLE_END = '[!$(*#*)&!D1&!$(C(F)(F)F)&!$(C(Cl)(Cl)Cl)&!$(C(Br)(Br)Br)&!$(C([CH3])([CH3])[CH3])&!$([CH3])]'

# Fixed value.
ROTATABLE_NO_AMIDE = '[!$(*#*)&!D1&!$(C(F)(F)F)&!$(C(Cl)(Cl)Cl)&!$(C(Br)(Br)Br)&!$(C([CH3])([CH3])[CH3])&!$([CH3])&!$([CD3](=[N,O,S])-!@[#7,O,S!D1])&!$([#7,O,S!D1]-!@[CD3]=[N,O,S])&!$([CD3](=[N+])-!@[#7!D1])&!$([#7!D1]-!@[CD3]=[N+])]'

# Unwanted groups of the desirability score; those with several parts are no patterns here and never match.
UNWANTED = [
    '*1[O,S,N]*1',
    '[S,C](=[O,S])[F,Br,Cl,I]',
    '[CX4][Cl,Br,I]',
    '[#6]S(=O)(=O)O[#6]',
    '[$([CH]),$(CC)]#CC(=O)[#6]',
    '[$([CH]),$(CC)]#CC(=O)O[#6]',
    'n[OH]',
    '[$([CH]),$(CC)]#CS(=O)(=O)[#6]',
    'C=C(C=O)C=O',
    'n1c([F,Cl,Br,I])cccc1',
    '[CH1](=O)',
    '[#8][#8]',
    '[C;!R]=[N;!R]',
    '[N!R]=[N!R]',
    '[#6](=O)[#6](=O)',
    '[#16][#16]',
    '[#7][NH2]',
    'C(=O)N[NH2]',
    '[#6]=S',
    '[$([CH2]),$([CH][CX4]),$(C([CX4])[CX4])]=[$([CH2]),$([CH][CX4]),$(C([CX4])[CX4])]',
    'C1(=[O,N])C=CC(=[O,N])C=C1',
    'C1(=[O,N])C(=[O,N])C=CC=C1',
    'a21aa3a(aa1aaaa2)aaaa3',
    'a31a(a2a(aa1)aaaa2)aaaa3',
    'a1aa2a3a(a1)A=AA=A3=AA=A2',
    'c1cc([NH2])ccc1',
    '[Hg,Fe,As,Sb,Zn,Se,se,Te,B,Si,Na,Ca,Ge,Ag,Mg,K,Ba,Sr,Be,Ti,Mo,Mn,Ru,Pd,Ni,Cu,Au,Cd,Al,Ga,Sn,Rh,Tl,Bi,Nb,Li,Pb,Hf,Ho]',
    'I',
    'OS(=O)(=O)[O-]',
    '[N+](=O)[O-]',
    'C(=O)N[OH]',
    'C1NC(=O)NC(=O)1',
    '[SH]',
    '[S-]',
    'c1ccc([Cl,Br,I,F])c([Cl,Br,I,F])c1[Cl,Br,I,F]',
    'c1cc([Cl,Br,I,F])cc([Cl,Br,I,F])c1[Cl,Br,I,F]',
    '[CR1]1[CR1][CR1][CR1][CR1][CR1][CR1]1',
    '[CR1]1[CR1][CR1]cc[CR1][CR1]1',
    '[CR2]1[CR2][CR2][CR2][CR2][CR2][CR2][CR2]1',
    '[CR2]1[CR2][CR2]cc[CR2][CR2][CR2]1',
    '[CH2R2]1N[CH2R2][CH2R2][CH2R2][CH2R2][CH2R2]1',
    '[CH2R2]1N[CH2R2][CH2R2][CH2R2][CH2R2][CH2R2][CH2R2]1',
    'C#C',
    '[OR2,NR2]@[CR2]@[CR2]@[OR2,NR2]@[CR2]@[CR2]@[OR2,NR2]',
    '[$([N+R]),$([n+R]),$([N+]=C)][O-]',
    '[#6]=N[OH]',
    '[#6]=NOC=O',
    '[#6](=O)[CX4,CR0X3,O][#6](=O)',
    'c1ccc2c(c1)ccc(=O)o2',
    '[O+,o+,S+,s+]',
    'N=C=O',
    '[NX3,NX4][F,Cl,Br,I]',
    'c1ccccc1OC(=O)[#6]',
    '[CR0]=[CR0][CR0]=[CR0]',
    '[C+,c+,C-,c-]',
    'N=[N+]=[N-]',
    'C12C(NC(N1)=O)CSC2',
    'c1c([OH])c([OH,NH2,NH])ccc1',
    'P',
    '[N,O,S]C#N',
    'C=C=O',
    '[Si][F,Cl,Br,I]',
    '[SX2]O',
    '[SiR0,CR0](c1ccccc1)(c2ccccc2)(c3ccccc3)',
    'O1CCCCC1OC2CCC3CCCCC3C2',
    'N=[CR0][N,n,O,S]',
    '[cR2]1[cR2][cR2]([Nv3X3,Nv4X4])[cR2][cR2][cR2]1[cR2]2[cR2][cR2][cR2]([Nv3X3,Nv4X4])[cR2][cR2]2',
    'C=[C!r]C#N',
    '[cR2]1[cR2]c([N+0X3R0,nX3R0])c([N+0X3R0,nX3R0])[cR2][cR2]1',
    '[cR2]1[cR2]c([N+0X3R0,nX3R0])[cR2]c([N+0X3R0,nX3R0])[cR2]1',
    '[cR2]1[cR2]c([N+0X3R0,nX3R0])[cR2][cR2]c1([N+0X3R0,nX3R0])',
    '[OH]c1ccc([OH,NH2,NH])cc1',
    'c1ccccc1OC(=O)O',
    '[SX2H0][N]',
    'c12ccccc1(SC(S)=N2)',
    'c12ccccc1(SC(=S)N2)',
    'c1nnnn1C=O',
    's1c(S)nnc1NC=O',
    'S1C=CSC1=S',
    'C(=O)Onnn',
    'OS(=O)(=O)C(F)(F)F',
    'N#CC[OH]',
    'N#CC(=O)',
    'S(=O)(=O)C#N',
    'N[CH2]C#N',
    'C1(=O)NCC1',
    'S(=O)(=O)[O-,OH]',
    'NC[F,Cl,Br,I]',
    'C=[C!r]O',
    '[NX2+0]=[O+0]',
    '[OR0,NR0][OR0,NR0]',
    'C(=O)O[C,H1].C(=O)O[C,H1].C(=O)O[C,H1]',
    '[CX2R0][NX3R0]',
    'c1ccccc1[C;!R]=[C;!R]c2ccccc2',
    '[NX3R0,NX4R0,OR0,SX2R0][CX4][NX3R0,NX4R0,OR0,SX2R0]',
    '[s,S,c,C,n,N,o,O]~[n+,N+](~[s,S,c,C,n,N,o,O])(~[s,S,c,C,n,N,o,O])~[s,S,c,C,n,N,o,O]',
    '[s,S,c,C,n,N,o,O]~[nX3+,NX3+](~[s,S,c,C,n,N])~[s,S,c,C,n,N]',
    '[*]=[N+]=[*]',
    '[SX3](=O)[O-,OH]',
    'N#N',
    'F.F.F.F',
    '[R0;D2][R0;D2][R0;D2][R0;D2]',
    '[cR,CR]~C(=O)NC(=O)~[cR,CR]',
    'C=!@CC=[O,S]',
    '[#6,#8,#16][#6](=O)O[#6]',
    'c[C;R0](=[O,S])[#6]',
    'c[SX2][C;!R]',
    'C=C=C',
    'c1nc([F,Cl,Br,I,S])ncc1',
    'c1ncnc([F,Cl,Br,I,S])c1',
    'c1nc(c2c(n1)nc(n2)[F,Cl,Br,I])',
    '[#6]S(=O)(=O)c1ccc(cc1)F',
    '[15N]',
    '[13C]',
    '[18O]',
    '[34S]',
]

# Named structural alerts.
ALERTS = [
    ('acyl_halide', '[CX3](=[OX1])[F,Cl,Br,I]'),
    ('sulfonyl_halide', '[SX4](=[OX1])(=[OX1])[F,Cl,Br,I]'),
    ('alkyl_halide', '[CX4][Cl,Br,I]'),
    ('aldehyde', '[CX3H1](=O)[#6]'),
    ('michael_acceptor', '[CX3]=[CX3][CX3]=[OX1]'),
    ('acetylene_ketone', 'C#C[CX3]=[OX1]'),
    ('epoxide', 'C1OC1'),
    ('aziridine', 'C1CN1'),
    ('beta_lactam', 'C1CC(=O)N1'),
    ('isocyanate', '[NX2]=C=[OX1]'),
    ('isothiocyanate', '[NX2]=C=[SX1]'),
    ('thiocyanate', '[SX2]C#N'),
    ('azide', '[NX2]=[NX2]=[NX1]'),
    ('azo', '[NX2]=[NX2]'),
    ('nitroso', '[NX2]=O'),
    ('nitro', '[NX3](=O)=O'),
    ('nitro_aromatic', '[a][NX3](=O)=O'),
    ('hydrazine', '[NX3][NX3]'),
    ('hydroxylamine', '[NX3][OX2H]'),
    ('peroxide', '[OX2][OX2]'),
    ('disulfide', '[SX2][SX2]'),
    ('thiol', '[SX2H]'),
    ('aldehyde_any', '[CX3H1]=O'),
    ('imine', '[CX3;!R]=[NX2;!R]'),
    ('anhydride', '[CX3](=[OX1])O[CX3](=[OX1])'),
    ('sulfonate_ester', '[#6]S(=O)(=O)O[#6]'),
    ('phosphonate_ester', 'P(=O)([OX2][#6])[OX2][#6]'),
    ('quaternary_nitrogen', '[NX4+]'),
    ('aromatic_nitroso', '[a][NX2]=O'),
    ('diketone_1_2', '[#6](=O)[#6](=O)'),
    ('triple_bond_chain', '[CX2]#[CX2]'),
    ('halopyridine', '[Cl,Br,I][c]'),
]
